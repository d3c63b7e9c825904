"""URL filters: a trie of allow and block entries, the longest match decides.

A rule is a host and the beginning of a path; it fits its host and all hosts below it.  The trie goes down the labels of the host from the
last to the first, then down the path's segments.  Of the rules that fit, the one with more labels wins, then the one with the longer
path, then block.  A url that no rule fits gets ``default``; that is ``allow``, as only what a block entry matches is to go.

Rules of up to ``TRIE_BYTES`` of text are broadcast as a trie.  Beyond that each distinct host and path meets the rules in a join on what
a rule can be for it: its host's endings and its path's beginnings.

Edge cases: a null url and one without ``://`` have an empty host and path, which a rule without a host and a path alone fits; hosts keep
their ports and user names; a path that is empty doesn't begin with ``/``; null parts of rules are empty; repeated rows are
judged each; extra columns pass through, and the result columns replace columns of the same name, whatever their case; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import free_name, quoted, table, without

#: Bytes of rules' text that are broadcast as a trie; beyond, rules are joined.
TRIE_BYTES = 16 << 20
RESULT = ("host", "path", "rule", "verdict")
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({quoted(url)}, instr({quoted(url)}, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def labels(host: str) -> list[str]:
    """From the last to the first; none of an empty host."""
    return host.split(".")[::-1] if host else []


def segments(path: str) -> list[str]:
    """Parts that end in ``/``, and what is left after the last of them."""
    *whole, last = path.split("/")
    return [f"{s}/" for s in whole] + [last]


class Paths:
    """Beginnings of paths by whole segments; at each node the beginnings of a segment that end rules there."""

    def __init__(self):
        self.children: dict[str, Paths] = {}
        self.ends: dict[str, str] = {}
        self.sizes: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        at, parts = self, segments(path)
        for s in parts[:-1]:
            at = at.children.setdefault(s, Paths())
        at.ends[parts[-1]] = "block" if "block" in (verdict, at.ends.get(parts[-1])) else verdict
        at.sizes = sorted({*at.sizes, len(parts[-1])}, reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        """The longest rule's path that ``path`` begins with, and its verdict."""
        at, begin, found, parts = self, 0, None, segments(path)
        for s in parts:
            for n in at.sizes:
                if n <= len(s) and s[:n] in at.ends:
                    found = path[: begin + n], at.ends[s[:n]]
                    break
            begin += len(s)
            at = at.children.get(s)
            if at is None:
                break
        return found


class Trie:
    """Hosts by labels from the last to the first; at each node the paths of the rules of that host."""

    def __init__(self, rules: Iterable[tuple[str | None, str | None, str]] = ()):
        self.children: dict[str, Trie] = {}
        self.paths: Paths | None = None
        for host, path, verdict in rules:
            at = self
            for label in labels((host or "").translate(str.maketrans(UPPER, LOWER))):
                at = at.children.setdefault(label, Trie())
            at.paths = at.paths or Paths()
            at.paths.add(path or "", verdict)

    def hosts(self, host: str) -> list[tuple[str, Paths]]:
        """Hosts with rules that ``host`` is or is below, the longest first."""
        at, names = self, labels(host)
        found = [("", self.paths)] if self.paths else []
        for n, label in enumerate(names, 1):
            at = at.children.get(label)
            if at is None:
                break
            if at.paths:
                found.append((".".join(names[:n][::-1]), at.paths))
        return found[::-1]

    def judge(self, hosts: list[tuple[str, Paths]], path: str) -> tuple[str, str] | None:
        for host, paths in hosts:
            if (met := paths.longest(path)) is not None:
                return host + met[0], met[1]
        return None


def _by_trie(parted: DataFrame, rules: DataFrame, host: str, path: str, judged: str, default: str) -> DataFrame:
    trie = parted.sparkSession.sparkContext.broadcast(Trie((r.host, r.path, r.verdict) for r in rules.collect()))  # at most TRIE_BYTES

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def longest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hosts = lru_cache(maxsize=1 << 14)(trie.value.hosts)
        for batch in batches:
            met = [trie.value.judge(hosts(h), p) or (None, default) for h, p in zip(*(c.to_pylist() for c in batch), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([m[k] for m in met], pa.string()) for k in (0, 1)], names=["rule", "verdict"])

    return parted.withColumn(judged, longest(quoted(host), quoted(path)))


def _by_join(parted: DataFrame, rules: DataFrame, host: str, path: str, judged: str, default: str) -> DataFrame:
    """Each distinct host and path once; of a path the beginnings up to a ``/`` and those that end a rule's segment."""
    rules = rules.groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("verdict"))
    rests = [r[0] for r in rules.select(F.length(F.regexp_extract("rule_path", "[^/]*$", 0))).distinct().collect()]  # lengths of segments
    asked = parted.select(F.col(quoted(host)).alias("host"), F.col(quoted(path)).alias("path")).distinct()
    ends = asked.select("*", F.explode(F.expr("""
        concat(array(''), if(host = '', array(), transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))))""")).alias("rule_host"))
    starts = F.transform(F.expr("filter(sequence(0, length(path)), i -> i = 0 or substring(path, i, 1) = '/')"), lambda i: F.array(*(i + n for n in rests)))
    sizes = F.array_distinct(F.filter(F.flatten(starts), lambda n: n <= F.length("path")))
    met = ends.select("*", F.explode(F.transform(sizes, lambda n: F.substring("path", F.lit(1), n))).alias("rule_path")).join(rules, ["rule_host", "rule_path"])
    best = met.groupBy("host", "path").agg(F.max_by(
        F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length("rule_host"), F.length("rule_path"))).alias(judged))
    best = best.select(F.col("host").alias(host), F.col("path").alias(path), judged)
    joined = parted.join(best, [host, path], "left")
    return joined.select(*map(quoted, parted.columns), F.coalesce(quoted(judged), F.struct(F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))).alias(judged))


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict, by rules (host, path, verdict)."""
    held = without(pages, set(RESULT), url)
    kept = [F.col(quoted(c)) for c in without(pages, set(RESULT)).columns]
    host, path, judged = (free_name(held, f"_{c}") for c in ("host", "path", "judged"))
    of = host_and_path(url)
    parted = held.select("*", F.coalesce(of[0], F.lit("")).alias(host), F.coalesce(of[1], F.lit("")).alias(path))
    listed = rules.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path", "verdict")))
    small = (listed.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0) <= trie_bytes
    out = (_by_trie if small else _by_join)(parted, listed, host, path, judged, default)
    return out.select(*kept, F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{judged}.rule").alias("rule"), F.col(f"{judged}.verdict").alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """Rows of ``pages`` whose url isn't blocked."""
    held = free_name(pages, "_row")
    judged = judge(pages.select(F.struct(*map(quoted, pages.columns)).alias(held), F.col(quoted(options.pop("url", "url"))).alias("url")), rules, **options)
    return judged.where("verdict <> 'block'").select(F.col(f"{held}.*"))


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op13(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_of(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH r(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), u AS (
  SELECT row_number() OVER () AS row, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT row, max({'labels': length(rule_host), 'path': length(rule_path), 'rule': rule_host || rule_path, 'verdict': verdict}) AS best
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (row)
"""
