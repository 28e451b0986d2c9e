"""URL filters on a sorted digest array.

A rule list is a table (host, path, verdict).  A rule fits its host and all
subdomains, if the url's path starts with the rule's; the longest fitting rule
wins (characters of host and path together, then of the host alone).  A url
that no rule fits gets the default verdict, since it is not in the array.

The list becomes one file in the shared folder: the 64-bit xxhash keys of all
hosts and of all (host, path) pairs in ascending order, and the strings they
stand for.  Spark ships the file to every executor (a new one fetches it
again); tasks memory-map it, probe the keys of a whole batch by one vectorised
binary search and compare the stored string of every hit, so that colliding
keys change nothing.  A url is probed with the suffixes of its host, then, for
the suffixes that rules name, with the prefixes of its path whose lengths occur.

A list of more than ``SHIPPED_BYTES`` (measured) is not shipped: the distinct
(host, path) pairs are joined with it on the same keys.

Defined cases: a null url, or one without ``://``, has empty host and path, no
rule and the default verdict; rows may repeat; of two rules with equal host and
path ``block`` wins; an empty list judges every url by default; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, batches_by_bytes, documents
from brokerlens.session import ensure_checkpoint_dir

SHIPPED_BYTES = 32 << 20     # of strings and keys of a rule list that is sent to every executor
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "host string, path string, verdict string"

# fixed values: the rules of op12
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def distinct_rules(rules: DataFrame) -> DataFrame:
    """Rules with lower-case hosts, one per host and path; ``block`` wins over ``allow``."""
    r = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return r.where("verdict IN ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


# ---- the sorted digest array ---------------------------------------------------------------------
def _host_key(host: str) -> bytes:
    return host.encode()


def _rule_key(host: str, path: str) -> bytes:
    return f"{host}\n{path}".encode()


def _digests(keys):
    import numpy as np
    import xxhash
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def packed(rules: list[tuple[str, str, str]]) -> bytes:
    """The file: counts, path lengths, sorted keys, string offsets, kinds (0 host, 1 allow, 2 block), strings."""
    import numpy as np
    entries = {_host_key(h): 0 for h, _, _ in rules} | {_rule_key(h, p): 2 if v == "block" else 1 for h, p, v in rules}
    keys = list(entries)
    digests = _digests(keys)
    order = np.argsort(digests, kind="stable")
    strings = [keys[i] for i in order]
    lengths = np.array(sorted({len(p) for _, p, _ in rules}), np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.uint64)]).astype(np.uint64)
    kinds = np.array([entries[s] for s in strings], np.uint8)
    head = np.array([len(strings), len(lengths)], np.uint64)
    return b"".join([head.tobytes(), lengths.tobytes(), digests[order].tobytes(), offsets.tobytes(), kinds.tobytes(), *strings])


class DigestArray:
    """A memory-mapped rule list."""

    def __init__(self, path: str):
        import numpy as np
        raw = np.memmap(path, np.uint8, "r")
        n, n_lengths = (int(x) for x in raw[:16].view(np.uint64))
        at = 16
        self.lengths = raw[at:at + 8 * n_lengths].view(np.uint64).tolist()
        at += 8 * n_lengths
        self.digests = raw[at:at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = raw[at:at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.kinds = raw[at:at + n]
        self.strings = raw[at + n:]

    def find(self, keys: list[bytes]):
        """Kind of each key (0 host, 1 allow, 2 block), -1 where the list does not hold it."""
        import numpy as np
        out = np.full(len(keys), -1, np.int8)
        if not keys or not len(self.digests):
            return out
        d = _digests(keys)
        at = np.searchsorted(self.digests, d)
        there = at < len(self.digests)
        there[there] = self.digests[at[there]] == d[there]
        for i in np.flatnonzero(there):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == d[i]:        # colliding keys stand side by side
                a, b = int(self.offsets[j]), int(self.offsets[j + 1])
                if b - a == len(keys[i]) and self.strings[a:b].tobytes() == keys[i]:
                    out[i] = self.kinds[j]
                    break
                j += 1
        return out

    def rule_of(self, hosts: list[str], paths: list[str]):
        """(rule, kind) of the longest rule that fits each url, (None, -1) without one."""
        found = [(None, -1)] * len(hosts)
        suffixes = sorted({s for h in set(hosts) for s in _suffixes(h)})
        named = {s for s, k in zip(suffixes, self.find([_host_key(s) for s in suffixes])) if k >= 0}
        if not named:
            return found
        of = {h: [s for s in _suffixes(h) if s in named] for h in set(hosts)}
        pairs = sorted({(s, p[:n]) for h, p in zip(hosts, paths) for s in of[h] for n in self.lengths if n <= len(p)})
        kinds = {x: int(k) for x, k in zip(pairs, self.find([_rule_key(*x) for x in pairs])) if k > 0}
        for i, (h, p) in enumerate(zip(hosts, paths)):
            fits = [(s, p[:n]) for s in of[h] for n in self.lengths if n <= len(p) and (s, p[:n]) in kinds]
            if fits:
                best = max(fits, key=lambda x: (len(x[0]) + len(x[1]), len(x[0])))
                found[i] = ("".join(best), kinds[best])
        return found


def _suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def _ship(spark: SparkSession, data: bytes) -> str:
    """Write the file to the shared folder and have Spark send it to the executors; its name there."""
    name = f"digests-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at:at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString() if path.toUri().getScheme() else "file://" + path.toString())
    Scratch.bases.append(path.toString())
    return name


def _probe(urls: DataFrame, name: str, default: str) -> DataFrame:
    kind = dict(urls.dtypes)["page_id"]

    def judge(batches):
        import pyarrow as pa
        from pyspark import SparkFiles
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = array.rule_of(hosts, paths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([r for r, _ in found], pa.string()),
                 pa.array([default if k < 0 else "block" if k == 2 else "allow" for _, k in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def _probe_by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for a list of any size: distinct (host, path) pairs against the list, joined on host suffix and path prefix."""
    pairs = urls.select("host", "path").distinct()
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))),
                                   lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\."))), ".")))
    hosts = pairs.select("host").distinct().select("host", suffix.alias("rule_host"))
    lengths = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.length("path")).alias("lengths"))
    tried = (pairs.join(hosts.join(lengths, "rule_host"), "host")
                  .select("host", "path", "rule_host", F.explode("lengths").alias("n")).where("n <= length(path)")
                  .select("host", "path", "rule_host", F.substring("path", F.lit(1), F.col("n")).alias("rule_path")))
    of = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"))
    rule = F.concat("rule_host", "rule_path")
    best = tried.join(of, ["rule_host", "rule_path"]).groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), F.col("verdict"))).alias("b"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url), by the rules (host, path, verdict).

    The list is sent to the executors only if its measured size is at most ``shipped_bytes``."""
    spark = pages.sparkSession
    batches_by_bytes(spark)
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = distinct_rules(rules)
    # two keys with offset and kind per rule, and its strings
    size = rules.agg(F.sum(2 * F.octet_length("host") + F.octet_length("path") + F.lit(40))).first()[0] or 0
    if size > shipped_bytes:
        return _probe_by_join(urls, rules, default)
    return _probe(urls, _ship(spark, packed([tuple(r) for r in rules.collect()])), default)


def q_op12(spark, sf_dir: str) -> DataFrame:
    """op12: every page's url judged by the fixed rules."""
    return judge_urls(documents(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULE))


SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest),
urls AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM parts),
best AS (SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
         FROM urls LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
         GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best"""
