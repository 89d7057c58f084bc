"""The library's front door."""

from .codecs import FORMATS, decoder, encoder
from .errors import EngineError
from .functions.values import display, kind, to_json
from .operators.transcode import decode, decode_blocks, encode, encode_rows, transcode
from .registry import Paths, add_file, compile_descriptor_set
from .sinks.records import write_records
from .sources.records import read_csv_rows, read_json_lines, read_raw_lines, read_records
from .streaming.records import stream_decoded, stream_records, stream_transcode

__all__ = ["FORMATS", "EngineError", "Paths", "add_file", "compile_descriptor_set", "decode", "decode_blocks", "decoder", "display", "encode", "encode_rows", "encoder", "kind", "read_csv_rows", "read_json_lines", "read_raw_lines", "read_records", "stream_decoded", "stream_records", "stream_transcode", "to_json", "transcode", "write_records"]
