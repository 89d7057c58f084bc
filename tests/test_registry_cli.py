import io
import os

import pytest

from recordloom import cli, registry
from recordloom.errors import IllegalState


def test_paths(tmp_path):
    assert registry.Paths(env={registry.HOME_VARIABLE: str(tmp_path)}).preferred_config("x") == tmp_path / "config" / "x"
    assert registry.Paths(env={"HOME": "/u"}).preferred_cache("x").as_posix() == "/u/.cache/recordloom/x"
    with pytest.raises(IllegalState):
        registry.Paths(env={})


def test_schemas_are_added_compiled_and_cached(tmp_path, monkeypatch):
    paths = registry.Paths(str(tmp_path / "home"))
    base = tmp_path / "base"
    (base / "foo").mkdir(parents=True)
    (base / "foo" / "a.proto").write_text('syntax="proto3"; package p; message A { int32 x = 1; }')
    monkeypatch.chdir(base)
    assert registry.add_file(paths, "foo/a.proto").relative_to(paths.data).as_posix() == "proto/foo/a.proto"
    assert registry.add_file(paths, "foo/a.proto", str(tmp_path / "home")).name == "a.proto"
    os.remove(paths.data / "proto" / "a.proto")
    assert registry.is_cache_stale(paths)
    registry.compile_descriptor_set(paths).message(".p.A")
    assert not registry.is_cache_stale(paths)
    added = paths.data / "proto" / "b.proto"
    added.write_text("message B {}")
    assert registry.is_cache_stale(paths)
    registry.compile_descriptor_set(paths).message(".B")
    added.unlink()
    assert registry.is_cache_stale(paths)  # a deletion is noticed


def parse(*words):
    return cli.parser().parse_args(words)


def test_flags():
    a = parse("-l", "info", "-jP", ".foo.Bar", "select x")
    assert a.input_json and a.output_protobuf == ".foo.Bar" and a.log == "info" and a.words == ["select x"]
    for fmt, letter in cli.INPUTS.items():
        given = [f"-{letter}"] + ["M"] * (fmt == "protobuf")
        assert cli.chosen(parse(*given), "input") == fmt
        assert cli.chosen(parse(f"--input-{cli.LONG.get(fmt, fmt)}", *given[1:]), "input") == fmt
    for fmt, letter in cli.OUTPUTS.items():
        given = [f"-{letter}"] + ["M"] * (fmt in ("protobuf", "avro"))
        assert cli.chosen(parse(*given), "output") == fmt
    assert cli.chosen(parse(), "input") == cli.chosen(parse(), "output") == "json"
    assert cli.chosen(parse("-j", "-c", "-y"), "input") == "cbor"
    for style in cli.STYLES:
        assert parse("--format", style).format == style
    assert cli.style(parse(), True) == "readable" and cli.style(parse(), False) == "compact"
    for bad in (["--format", "x"], ["--help"]):
        with pytest.raises(SystemExit):
            parse(*bad)


def test_standard_streams(tmp_path, monkeypatch):
    def run(data, *words):
        out = io.BytesIO()
        return cli.main(list(words) + ["-q"], io.BytesIO(data), out), out.getvalue()

    code, data = run(b'null true {"a": 2.5}', "-jC")
    assert code == 0 and run(data, "-cJ") == (0, b'null\ntrue\n{"a":2.5}\n')
    assert run(b"1 {", "-j")[0] == 1 and run(b"1 {", "-j")[1] == b"1\n"  # what came before an error is written
    assert run(b"1", "-j", "select x")[0] == 1
    assert run(b"1", "-jP", ".a.B")[0] == 1
    monkeypatch.setenv(registry.HOME_VARIABLE, str(tmp_path))
    proto = tmp_path / "person.proto"
    proto.write_text('syntax="proto3"; package example; message Person { string name = 1; int32 age = 2; }')
    assert run(b"", "protobuf", "add", str(proto), "-b", str(tmp_path)) == (0, b"")
    assert run(b"\x0a\x04John\x10\x22", "-p", ".example.Person") == (0, b'{"name":"John","age":34}\n')
    schema = tmp_path / "s.avsc"
    schema.write_text('"long"')
    code, data = run(b"1 2", "-jA", str(schema), "--codec", "deflate")
    assert code == 0 and run(data, "-aJ") == (0, b"1\n2\n")
    assert run(b"1", "-jA", str(schema), "--codec", "zip")[0] == 1
