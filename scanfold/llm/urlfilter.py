"""URL verdicts by host rules and, where none fits, by a weighted vocabulary found with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One strict term rejects a url, SOFT_LIMIT distinct soft terms reject it.
STRICT = ("casino", "escort", "malware", "phishing", "porn", "pornhub", "sex", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("adult", "ads", "bet", "bonus", "cheap", "clickbait", "crack", "dating", "farm", "free", "keygen", "loan", "nude", "pills", "poker", "promo", "slots", "spam", "torrent", "track", "win")
SOFT_LIMIT = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, with all its subdomains, where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.char_length(rest) + 4)
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, _UPPER, _LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    after = F.substr(url, F.char_length(F.substring_index(url, "://", 1)) + 4)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The name (host and path) and verdict of the longest rule that fits, null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def term_hits(urls: DataFrame, url_col: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> DataFrame:
    """``urls`` with strict_hits and soft_hits: distinct terms that stand in the url between characters other than
    letters and digits, whatever their case. One pass of an automaton over each url finds all terms."""
    names = urls.columns
    at = names.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for kind, terms in ((0, strict), (1, soft)):
            for t in terms:
                machine.add_word(t, (kind, t))
        machine.make_automaton()
        fold = str.maketrans(_UPPER, _LOWER)
        plain = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            counts = [[], []]
            for url in batch.column(at).to_pylist():
                low = (url or "").translate(fold)
                found = (set(), set())
                for end, (kind, t) in machine.iter(low):
                    start = end - len(t)
                    if (start < 0 or low[start] not in plain) and (end + 1 == len(low) or low[end + 1] not in plain):
                        found[kind].add(t)
                counts[0].append(len(found[0])), counts[1].append(len(found[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts[0], pa.int32()), pa.array(counts[1], pa.int32())], names=[*names, "strict_hits", "soft_hits"])

    return urls.mapInArrow(run, T.StructType([*urls.schema.fields, T.StructField("strict_hits", T.IntegerType()), T.StructField("soft_hits", T.IntegerType())]))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """id_col, host, path, rule, verdict (allow or block), strict_hits and soft_hits of every row.

    A null url, or one without ``://``, has an empty host and path, no rule and, as a null has no terms, is allowed.
    Null and repeated ids are ordinary rows; other columns are not read.
    """
    hits = term_hits(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), "url", strict, soft)
    out = hits.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "strict_hits", "soft_hits")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    return out.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits")


def oracle_sql() -> str:
    def count(terms: tuple[str, ...]) -> str:
        return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)

    fits = sorted(RULES, key=lambda r: -(len(r.host) + len(r.path)))
    cond = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in fits}
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits FROM u)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {cond[r]} THEN '{r.host}{r.path}'" for r in fits)} END AS rule,
    CASE {" ".join(f"WHEN {cond[r]} THEN '{r.verdict}'" for r in fits)}
         WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
    CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits FROM p
"""
