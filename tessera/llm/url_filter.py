"""URL filter: pattern rules indexed by their rarest literal token (native expressions only).

A rule is (verdict, host, path). It fits its host and every subdomain if the URL's path starts with the rule's path;
``*`` in a path stands for any run of characters. Each rule is filed under one literal token: of the tokens that a
fitting URL must contain whole, the one that the fewest rules contain (ties: the longest, then the smallest). A URL's
tokens fetch the rules filed under them, and only those whose literal ends agree run their regular expression. Of the
fitting rules the longest (host and path) wins, then the longer host, then the smaller rule text.

The index is a hash table: a constant array of buckets, in which a token's CRC-32 names the place. Up to `inline_rules`
rules it travels inside the plan, and a look-up costs the same for any number of rules; there is no join and no shuffle.
More rules are joined by token in blocks of that many, each broadcast, so that frequent tokens of URLs meet on no task.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and gets the default
verdict. A rule path that ends inside a token gives no token there; a rule without any token is tried on every URL.
Capitals in a rule's host count as small letters (A-Z). Of rules of the same text the first listed counts. Repeated
rows and null ids stay as they are; all columns of the input are kept, whatever their names and types, but for those
named like an output (in any case), which are replaced. An empty rule list gives the default verdict everywhere.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_KEYS, named, others, private

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = "token string, size int, host_size int, rule string, verdict string, host string, head string, regex string"
TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Rules up to this count travel inside the plan (some 200 bytes each), and rules of one broadcast beyond it.
INLINE_RULES = 20_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path) of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_regex(rule: Rule) -> str:
    path = "[\\s\\S]*".join(_quoted(x) for x in rule.path.split("*"))
    return r"^(?:[^/?#]*\.)?" + _quoted(rule.host) + r"\u0001" + path


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_ -])", r"\\\1", literal)


def rule_tokens(rule: Rule) -> list[str]:
    """Tokens that every URL fitting the rule contains as whole tokens."""
    found = TOKEN.findall(rule.host)
    last = len(rule.path)
    for m in TOKEN.finditer(rule.path):
        before = rule.path[m.start() - 1] if m.start() else "/"
        if before != "*" and m.end() < last and rule.path[m.end()] != "*":
            found.append(m.group())
    return found


def distinct_rules(rules: Sequence[Rule]) -> list[Rule]:
    """The first rule of each text, hosts in small letters."""
    folded = (Rule(r.verdict, r.host.translate(str.maketrans(UPPER, LOWER)), r.path) for r in rules)
    return list({(r.host, r.path): r for r in reversed(list(folded))}.values())[::-1]


def index_rules(rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; those without one under the empty string."""
    tokens = {rule: rule_tokens(rule) for rule in distinct_rules(rules)}
    frequency = Counter(t for own in tokens.values() for t in set(own))
    index: dict[str, list[Rule]] = {}
    for rule, own in tokens.items():
        key = min(own, key=lambda t: (frequency[t], -len(t), t), default="")
        index.setdefault(key, []).append(rule)
    return index


def _entries(index: dict[str, list[Rule]]) -> Iterator[dict]:
    for token, own in index.items():
        for r in own:
            yield {"token": token, "size": len(r.text), "host_size": len(r.host), "rule": r.text, "verdict": r.verdict, "host": r.host, "head": r.path.split("*")[0], "regex": rule_regex(r)}


def hash_table(index: dict[str, list[Rule]]) -> list[list[dict]]:
    """Entries by place: the CRC-32 of their token below the number of places, a power of two."""
    table: list[list[dict]] = [[] for _ in range(1 << (2 * len(index)).bit_length())]
    for entry in _entries(index):
        table[zlib.crc32(entry["token"].encode()) % len(table)].append(entry)
    return table


def _tokens(host: Column, path: Column) -> Column:
    words = F.split(F.concat_ws("/", host, path), "[^A-Za-z0-9]+")
    return F.array_distinct(F.concat(words, F.array(F.lit(""))))


def _fits(entry: Column, host: Column, path: Column) -> Column:
    """The literal ends of a rule first, then its regular expression."""
    ends = F.endswith(host, entry["host"]) & F.startswith(path, entry["head"])
    return F.when(ends, F.rlike(F.concat(host, F.lit("\u0001"), path), entry["regex"])).otherwise(F.lit(False))


def _best(hits: Column) -> Column:
    """The winning entry: longest, then longest host, then smallest rule text."""
    return F.get(F.array_sort(hits, lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"])
                              .when(a["host_size"] != b["host_size"], b["host_size"] - a["host_size"])
                              .when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0)), 0)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict."""
    host, path = url_parts(named(url))
    pages = pages.select(*map(named, others(pages, "host", "path", "rule", "verdict")), host.alias("host"), path.alias("path"))
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    best = private(pages, "_best")
    judged = _inline(pages, rules, best) if len(rules) <= inline_rules else _joined(pages, rules, best, max(1, inline_rules or INLINE_RULES))
    return judged.withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}).drop(best)


def _inline(pages: DataFrame, rules: Sequence[Rule], best: str) -> DataFrame:
    """No shuffle: the index is a constant of the plan, folded once."""
    table = hash_table(index_rules(rules))
    lookup = F.from_json(F.lit(json.dumps(table)), f"array<array<struct<{ENTRY}>>>")
    fetch = lambda t: F.filter(F.get(lookup, F.pmod(F.crc32(t.cast("binary")), F.lit(len(table))).cast("int")), lambda e: e["token"] == t)
    found = private(pages, "_found")
    pages = pages.withColumn(found, F.flatten(F.transform(_tokens(F.col("host"), F.col("path")), fetch)))
    return pages.withColumn(best, _best(F.filter(F.col(found), lambda e: _fits(e, F.col("host"), F.col("path"))))).drop(found)


def _joined(pages: DataFrame, rules: Sequence[Rule], best: str, block: int) -> DataFrame:
    """Very many rules: distinct host and path pairs meet blocks of the index, each broadcast, by token."""
    spark = pages.sparkSession
    rows = [tuple(e.values()) for e in _entries(index_rules(rules))]
    urls = pages.select("host", "path").distinct()
    probes = urls.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    parts = []
    for i in range(0, len(rows), block):
        index = spark.createDataFrame(rows[i : i + block], ENTRY).select("token", F.struct("size", "host_size", "rule", "verdict", "host", "head", "regex").alias("entry"))
        parts.append(probes.join(F.broadcast(index), "token").filter(_fits(F.col("entry"), F.col("host"), F.col("path"))).select("host", "path", "entry"))
    order = F.struct(F.col("entry.size"), F.col("entry.host_size"))
    ranked = reduce(DataFrame.unionByName, parts).groupBy("host", "path", order.alias("order")).agg(F.min_by("entry", "entry.rule").alias("entry"))
    top = ranked.groupBy("host", "path").agg(F.max_by("entry", "order").alias(best))
    small = top.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return pages.join(F.broadcast(top) if small else top, ["host", "path"], "left")
