"""URL filters: many wildcard rules at once, by a bit-parallel automaton.

Every rule is a glob over a canonical URL ``.host/path``: ``*`` stands for any run without ``/``, ``**`` for any run.
All rules are packed into one nondeterministic automaton whose states are bits of several 64-bit words
(Shift-And with self-loops for wildcards); one pass over the characters moves all states of all rules.

Null or scheme-less URLs have an empty host and path and match no rule. Ties in length go to the earlier rule.
Repeated rows, empty tables and extra columns are fine: each row is judged by itself, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``; verdict ``allow`` or ``block``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class GlobAutomaton:
    """All globs at once: state j of a glob means that its first j literals have been read."""

    def __init__(self, globs: list[str]):
        parsed = []
        for glob in globs:
            literals, loops, i = [], {}, 0  # loops: state -> whether "/" keeps it too
            while i < len(glob):
                if glob[i] == "*":
                    any_char = glob[i : i + 2] == "**"
                    loops[len(literals)] = loops.get(len(literals), False) or any_char
                    i += 1 + any_char
                else:
                    literals.append(glob[i])
                    i += 1
            parsed.append((literals, loops))
        alphabet = sorted({c for literals, _ in parsed for c in literals} | {"/"})
        self.classes = {c: k + 1 for k, c in enumerate(alphabet)}  # class 0: any other character
        n_bits = sum(len(literals) + 1 for literals, _ in parsed)
        self.words = max(1, -(-n_bits // 64))
        self.step = np.zeros((self.words, len(alphabet) + 1), np.uint64)
        self.stay = np.zeros_like(self.step)
        self.start = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        at, slash = 0, self.classes["/"]
        for literals, loops in parsed:
            self._set(self.start, at)
            for j, c in enumerate(literals):
                self._set(self.step[:, self.classes[c]], at + j + 1)
            for j, any_char in loops.items():
                for k in range(len(alphabet) + 1):
                    if any_char or k != slash:
                        self._set(self.stay[:, k], at + j)
            end = at + len(literals)
            self.accept.append((end // 64, np.uint64(1 << (end % 64))))
            at = end + 1
        self.ascii = np.zeros(128, np.int64)
        for c, k in self.classes.items():
            if ord(c) < 128:
                self.ascii[ord(c)] = k
        self.beyond = {ord(c): k for c, k in self.classes.items() if ord(c) >= 128}

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    def first_match(self, texts: list[str]) -> np.ndarray:
        """For each text the lowest index of a glob that matches all of it, else -1."""
        n = len(texts)
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lengths = np.array([len(p) for p in points], np.int64)
        order = np.argsort(-lengths, kind="stable")  # the longest first: those still running are a prefix
        flat = np.concatenate([points[i] for i in order] or [np.zeros(0, np.uint32)])
        codes = self.ascii[np.minimum(flat, 127)] * (flat < 128)
        for point, k in self.beyond.items():
            codes[flat == point] = k
        lengths = lengths[order]
        begins = np.cumsum(lengths) - lengths
        state = np.repeat(self.start[:, None], n, axis=1)
        running = n
        for t in range(int(lengths[0]) if n else 0):
            while running and lengths[running - 1] <= t:
                running -= 1
            now, code = state[:, :running], codes[begins[:running] + t]
            moved = now << np.uint64(1)
            moved[1:] |= now[:-1] >> np.uint64(63)
            state[:, :running] = (moved & self.step[:, code]) | (now & self.stay[:, code])
        found = np.full(n, -1, np.int64)
        for k in range(len(self.accept) - 1, -1, -1):
            word, bit = self.accept[k]
            found[order[(state[word] & bit) != 0]] = k
        return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = (), default: str = "allow", batch: int = 4096) -> DataFrame:
    """Columns ``keep``, then host, path, rule (the longest that fits, else null) and verdict (the rule's, else ``default``)."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = GlobAutomaton([r.glob for r in ranked])

    @F.pandas_udf("int")
    def match(canonical: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in canonical:
            found = [automaton.first_match(texts.iloc[i : i + batch].tolist()) for i in range(0, len(texts), batch)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0, np.int64)).astype("int32")

    host, path = url_parts(F.col(url).cast("string"))
    out = df.select(*keep, host.alias("host"), path.alias("path")).withColumn("_rule", match(F.concat(F.lit("."), "host", "path")))
    names = F.array(*(F.lit(r.name) for r in ranked)) if ranked else F.array(F.lit(""))
    verdicts = F.array(*(F.lit(r.verdict) for r in ranked)) if ranked else F.array(F.lit(default))
    hit = F.col("_rule") >= 0
    return out.select(*keep, "host", "path", F.when(hit, F.get(names, F.col("_rule"))).alias("rule"), F.when(hit, F.get(verdicts, F.col("_rule"))).otherwise(F.lit(default)).alias("verdict"))


#: The rules of query op10_url_filters.
QUERY_RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    from .common import pick, table

    return filter_urls(pick(table(spark, sf_dir, "pages"), page_id="long", url="string"), QUERY_RULES, keep=("page_id",))


OP10_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM p),
r AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM q),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, (SELECT max_by(struct_pack(rule := rh || rp, verdict := verdict), length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS hit FROM r)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM m
"""
