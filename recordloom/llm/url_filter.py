"""URL filters: a URL's host-suffix and path-prefix expressions meet the rules on short hash prefixes; full digests and
the rules' precedence decide."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
#: Bytes of the digest that the join compares.
PREFIX_BYTES = 4
#: Rules up to this number are a constant of the plan, probed within each row; more are joined by a shuffle.
MOST_IN_ROW = 2_000
#: Copies of a verdict, and of a rule that fits, that rows of a hot URL or a common expression are dealt to.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path: after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def expressions(hosts: list[int], paths: list[int]) -> str:
    """SQL: a struct (h, p) for each host suffix of one of the given numbers of labels with each path prefix of one of the
    given lengths: the shapes that rules have, so that their number follows the rules and not the URL."""
    labels = f"array({', '.join(map(str, hosts))})"
    lengths = f"array({', '.join(map(str, paths))})"
    suffixes = f"filter({labels}, k -> k <= size(split(host, '[.]')))"
    prefixes = f"filter({lengths}, l -> l <= char_length(path))"
    return f"flatten(transform({suffixes}, k -> transform({prefixes}, l -> struct(substring_index(host, '.', -k) AS h, substring(path, 1, l) AS p))))"


def digest(h: str, p: str) -> str:
    return f"sha2(concat_ws('\n', {h}, {p}), 256)"


def ranked(rules: list[Rule]) -> list[tuple[int, Rule]]:
    """Rules by precedence, the winner of any two has the larger number: the longer, then a block, then the smaller text."""
    own = dict.fromkeys(Rule(r.verdict, r.host.translate(str.maketrans(UPPER, LOWER)), r.path) for r in rules)
    by_text = sorted(own, key=lambda r: r.host + r.path, reverse=True)
    return list(enumerate(sorted(by_text, key=lambda r: (len(r.host + r.path), r.verdict == "block"))))


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_in_row: int = MOST_IN_ROW) -> DataFrame:
    """page_id, host, path, rule (as host/path text, else null), verdict for each row of pages.

    A rule fits its host and all its subdomains where the path starts with the rule's. The longest rule text wins; of
    equally long ones a block, then the smaller text. Where none fits, the verdict is default. A null URL or one without
    :// has an empty host and path; a very long one has no more expressions than a short one. Repeated rows and ids each give their
    row, other columns are not read, whatever their names, and no pages give no rows. Up to most_in_row rules are probed within
    each row, without a shuffle. More are joined with the distinct expressions of all URLs, so a common one such as com/ is one row there,
    and what fits comes back to the rows over salted keys.
    """
    urls = url_parts(pick(pages, page_id=id_col, url=url_col)).select("page_id", "host", "path")
    if not rules:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    named, n = ranked(rules), 2 * PREFIX_BYTES
    asked = expressions(sorted({r.host.count(".") + 1 for _, r in named}), sorted({len(r.path) for _, r in named}))
    if len(named) <= most_in_row:
        by_prefix: dict[str, list] = {}
        for k, r in named:
            full = hashlib.sha256(f"{r.host}\n{r.path}".encode()).hexdigest()
            by_prefix.setdefault(full[:n], []).append(F.struct(F.lit(k).alias("rank"), F.lit(full).alias("digest"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
        table_ = F.map_from_arrays(F.array(*map(F.lit, by_prefix)), F.array(*(F.array(*v) for v in by_prefix.values())))
        digests = F.transform(F.expr(asked), lambda x: F.sha2(F.concat_ws("\n", x["h"], x["p"]), 256))
        hits = F.flatten(F.transform(digests, lambda d: F.filter(F.coalesce(F.try_element_at(table_, F.substring(d, 1, n)), F.array().cast("array<struct<rank: int, digest: string, rule: string, verdict: string>>")), lambda r: r["digest"] == d)))
        best = urls.withColumn("best", F.array_max(hits))
        return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    side = pages.sparkSession.createDataFrame([(k, r.host, r.path, r.verdict) for k, r in named], "rank int, r_host string, r_path string, r_verdict string")
    side = side.withColumn("r_digest", F.expr(digest("r_host", "r_path"))).withColumn("prefix", F.substring("r_digest", 1, n))
    once = urls.select("host", "path").distinct()
    expanded = once.select("host", "path", F.explode(F.expr(asked)).alias("x")).select("host", "path", "x.h", "x.p")
    whole = expanded.select("h", "p").distinct().withColumn("digest", F.expr(digest("h", "p"))).withColumn("prefix", F.substring("digest", 1, n))
    fits = whole.join(side, "prefix").where("digest = r_digest").select("h", "p", "rank", F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hits = expanded.withColumn("salt", F.pmod(F.hash("host", "path"), F.lit(SALTS))).join(fits.select("*", salts), ["h", "p", "salt"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    out = urls.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS))).join(best.select("*", salts), ["host", "path", "salt"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _fits(r: Rule) -> str:
    return f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"


_by_length = sorted(RULES, key=lambda r: (-len(r.host + r.path), r.verdict != "block", r.host + r.path))
ORACLE = (
    "WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages), "
    f"s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u) "
    "SELECT page_id, host, path, CASE "
    + " ".join(f"WHEN {_fits(r)} THEN '{r.host}{r.path}'" for r in _by_length)
    + " END AS rule, CASE "
    + " ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _by_length)
    + " ELSE 'allow' END AS verdict FROM s"
)
