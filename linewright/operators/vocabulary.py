"""Names, aliases and rules that texts are searched for.

They are dimension tables: read from any DataFrame, checked against ``MOST`` entries, and sent to the workers as one automaton
of all entries. It names the few entries that a text holds in one pass over it, whatever their number; built-in expressions
then judge these. A search is a map over rows, in batch and in streams, without a join.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, compact, compact_alnum, is_label, rule_key, split_labels

MOST = 200_000  # about 200 MB of automaton in a worker

# Rule keys that name no brand and no product.
NO_BRANDS = ["new", "hot", "sale", "review", "video", "shop", "store", "official", "chinh hang", "combo", "free", "ship", "freeship"]
NO_PRODUCTS = ["sua", "sua me", "sua bot", "sua uong", "sua cong thuc", "san pham do hop", "lo sua cong thuc", "thdt", "d en", "dien", "d ien", "cp", "ns", "60", "antem", "anthem", "kem", "serum", "mask", "mascara", "cleanser", "pate", "tra sua", "sua rua mat", "sua tam", "dau goi", "tay da chet", "kem chong nang"]
NO_ALIASES = ["", "review", "tiktok", "sale", "deal", "voucher", "freeship", "official", "shop", "store", "chinh hang", "hang moi", "mau moi", "san pham", "thuc pham", "my pham", "do an", "mon ngon", "serum", "scrub", "mascara", "sunscreen", "cleanser", "cream", "wash", "body scrub", "tra sua", "banh", "pate", "combo", "gold", "baby", "kid", "k2", "d3", "dha"]


def collected(df: DataFrame) -> list:
    """All rows of a dimension table, which may hold ``MOST`` at most."""
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} entries")
    return rows


def held_entries(norm: Column, packed: Column, rows: list, whole: str, inner: str, least: int, /, **types: str) -> Column:
    """Those of ``rows``, as structs in their order, whose ``whole`` field is inside ``norm``, or whose ``inner`` field (``least`` characters or more) inside ``packed``."""
    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in types.items()) + ">>"
    if not rows:
        return F.array().cast(kind)
    keys = [(r[whole] or "", (r[inner] or "") if len(r[inner] or "") >= least else "") for r in rows]
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = {n: [r[n] if r[n] is None or t != "double" else float(r[n]) for r in rows] for n, t in types.items()}

    @F.arrow_udf(kind)
    def held(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import ahocorasick

        entries = pa.StructArray.from_arrays([pa.array(v, arrow[types[n]]) for n, v in fields.items()], list(types))
        found = []
        for side in (0, 1):
            numbers: dict[str, list[int]] = {}
            for k, pair in enumerate(keys):
                if pair[side]:
                    numbers.setdefault(pair[side], []).append(k)
            automaton = ahocorasick.Automaton()
            for phrase, own in numbers.items():
                automaton.add_word(phrase, own)
            automaton.make_automaton()
            found.append(automaton if numbers else None)

        for pair in batches:  # texts are taken from a batch one by one, and what they hold are numbers
            counts, held = array("i", [0]), array("q")
            for texts in zip(*pair):
                texts = (t.as_py() for t in texts)
                held.extend(sorted({k for automaton, text in zip(found, texts) if automaton and text for _, own in automaton.iter(text) for k in own}))
                counts.append(len(held))
            yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), entries.take(pa.array(held, pa.int64())))

    return held(norm, packed)


def brand_gazetteer(labels: DataFrame, canonical: dict[str, str] | None = None, column: str = "brand_name", builtin: tuple[str, ...] = ()) -> DataFrame:
    """brand, norm, compact and char_len, one row for each norm, in no order. ``canonical``: norm to preferred name."""
    names = labels.select(F.explode(split_labels(F.col(column))).alias("brand"))
    if builtin:
        names = names.unionByName(labels.sparkSession.createDataFrame([(b,) for b in builtin], "brand string"))
    brand = clean(F.col("brand"))
    if canonical:
        brand = F.coalesce(F.create_map(*(F.lit(x) for kv in canonical.items() for x in kv))[rule_key(F.col("brand"))], brand)
    named = names.where(is_label(F.col("brand"))).distinct().select(brand.alias("brand")).withColumns({"norm": rule_key(F.col("brand")), "compact": compact(F.col("brand"))})
    named = named.where((F.length("norm") >= 2) & ~F.col("norm").isin(NO_BRANDS))
    return named.groupBy("norm").agg(F.min("brand").alias("brand"), F.min("compact").alias("compact")).select("brand", "norm", "compact", F.length("norm").alias("char_len"))


def is_dirty_product(c: Column) -> Column:
    n = rule_key(c)
    tokens = F.split(n, " ")
    return n.isin("", *NO_PRODUCTS) | n.rlike(r"^\d+$") | (F.length(n) <= 3) | ((F.size(tokens) == 1) & (F.length(n) < 5)) | (F.size(F.filter(tokens, lambda t: F.length(t) == 1)) >= 2)


def product_gazetteer(labels: DataFrame, column: str = "product_name") -> DataFrame:
    """product, norm, compact, char_len and freq, the most frequent spelling of each norm (ties: smaller)."""
    named = labels.select(F.explode(split_labels(F.col(column))).alias("product")).groupBy("product").agg(F.count(F.lit(1)).alias("freq"))
    named = named.where(is_label(F.col("product")) & ~is_dirty_product(F.col("product"))).withColumns({"norm": rule_key(F.col("product")), "compact": compact(F.col("product"))})
    best = named.groupBy("norm").agg(F.max(F.struct("freq", F.struct("product", "compact"))).alias("_b"), F.min(F.struct(-F.col("freq"), "product", "compact")).alias("_m"))
    return best.select(F.col("_m.product").alias("product"), "norm", F.col("_m.compact").alias("compact"), F.length("norm").alias("char_len"), F.col("_b.freq").alias("freq"))


def alias_table(aliases: DataFrame) -> DataFrame:
    """canonical_ord, canonical, alias_ord and alias, with keys, of aliases that are long and telling enough."""
    norm, short = rule_key(F.col("canonical")), F.length(rule_key(F.col("canonical")))
    sound = ~norm.isin(NO_ALIASES) & short.between(3, 35) & F.col("canonical").rlike("[a-zA-ZÀ-ỹ]")
    out = aliases.where(sound).withColumns({"alias_norm": rule_key(F.col("alias")), "alias_compact": compact_alnum(F.col("alias"))})
    return out.where(~F.col("alias_norm").isin(NO_ALIASES) & (F.length(F.replace("alias_norm", F.lit(" "), F.lit(""))) > 2))


@dataclass(frozen=True)
class Rule:
    """``patterns`` are regular expressions over the rule key, or aliases where a stage says so; earlier rules win."""

    canonical: str
    patterns: tuple[str, ...]
    reason: str = ""
    lines: tuple[str, ...] = ()
