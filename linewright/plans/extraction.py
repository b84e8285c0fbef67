"""Queries of gazetteers, rules, phrases, aliases, the cascade, recogniser JSON, geometry, models and streams."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions.text import compact_alnum, rule_key
from ..operators import extract as ex
from ..operators import images, ml, ocr_json
from ..operators import vocabulary as vc
from ..operators.lines import spread
from ..operators.vocabulary import Rule
from ..sources import models
from ..streaming import extract as stream
from .adapters import LINES, PARTS, RULE_KEY, RULES, lines, part_labels, phrase_rules, table
from .texts import ORACLES as TEXT_ORACLES

DEMO_RULES = [Rule("STEEL", (r"\bsteel\b",)), Rule("BRUSHED NICKEL", (r"\bbrushed nickel\b", r"\bnickel\b")), Rule("TIN", (r"\btin\b",)), Rule("COPPER", (r"\bcopper\b",))]


def _gazetteers(spark, sf):
    p = part_labels(spark, sf)
    return vc.collected(vc.brand_gazetteer(p)), vc.collected(vc.product_gazetteer(p))


def _evidence(spark, sf):
    return spread(part_labels(spark, sf)).select("item_id", "ocr_text", F.concat_ws(" || ", "ocr_text", "ocr_text").alias("evidence_text"))


def _rule_rows(spark, sf):
    r = phrase_rules(spark, sf)
    return vc.collected(r.select("rule_rank", "canonical", rule_key(F.col("pattern")).alias("alias_norm"), compact_alnum(F.col("pattern")).alias("alias_compact")))


def _aliases(spark, sf):
    r = phrase_rules(spark, sf).select(F.col("rule_rank").alias("canonical_ord"), "canonical", F.lit(0).cast("long").alias("alias_ord"), F.col("pattern").alias("alias"))
    return vc.collected(vc.alias_table(r))


def brand_gazetteer(spark, sf):
    return vc.brand_gazetteer(part_labels(spark, sf))


def product_gazetteer(spark, sf):
    return vc.product_gazetteer(part_labels(spark, sf))


def brand_hits(spark, sf):
    brands, _ = _gazetteers(spark, sf)
    return ex.rulebase(_evidence(spark, sf), brands, []).select("item_id", F.col("brand_v3").alias("brands"))


def product_gaz_top3(spark, sf):
    _, products = _gazetteers(spark, sf)
    return ex.rulebase(_evidence(spark, sf), [], products).select("item_id", F.col("product_v3").alias("products"))


def first_match_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", rule_key(F.col("text")).alias("n")).withColumn("p", F.regexp_replace("n", "[^a-z0-9]+", ""))
    docs = docs.withColumn("held", ex.held_rules(F.col("n"), F.col("p"), _rule_rows(spark, sf)))
    return docs.select("doc_id", ex.first_alias_rule(F.col("n"), F.col("p"), F.col("held")).alias("rule"))


def all_match_rules(spark, sf):
    return part_labels(spark, sf).select("item_id", F.array_join(ex.rule_products(rule_key(F.col("ocr_text")), DEMO_RULES, {"TIN": ("STEEL",)}), "|").alias("rules"))


def regex_first_match(spark, sf):
    return part_labels(spark, sf).select("item_id", F.coalesce(ex.first_rule(rule_key(F.col("ocr_text")), DEMO_RULES), F.lit("")).alias("rule"))


def baseline_rules(spark, sf):
    rules = [Rule("Steel Works", ("steel",), lines=("polished", "brushed")), Rule("Tin Town", ("tin",), lines=("anodized",)), Rule("Copper", ("copper",))]
    return part_labels(spark, sf).select("item_id", ex.baseline_product(F.col("ocr_text"), rules).alias("b")).select("item_id", "b.brand", "b.product")


def alias_score_margin(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("ocr_text"), F.col("text").alias("evidence_text"))
    return ex.alias_brand(docs, _aliases(spark, sf)).select("doc_id", "brand_v5", "brand_v5_score")


def alias_top5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("ocr_text"), F.col("text").alias("evidence_text"))
    return ex.alias_brand(docs, _aliases(spark, sf)).select("doc_id", "brand_v5_top")


def baseline_text(spark, sf):
    return ocr_json.corner_text(lines(spark, sf), ["doc_id"], "x", "y")


def model_bundle(spark, sf):
    """A product model saved, loaded again and applied; and one that is not there, in whose place nothing is loaded."""
    path = f"{_scratch(spark)}/bundle-{uuid.uuid4().hex}"
    p = part_labels(spark, sf).select("item_id", F.length("ocr_text").cast("double").alias("size"))
    from pyspark.ml.feature import VectorAssembler

    models.save_bundle(path, {"sizes": VectorAssembler(inputCols=["size"], outputCol="vector")})
    found = models.load_bundle(spark, path, ["sizes", "absent"])
    return found["sizes"].transform(p).select("item_id", F.col("vector").cast("string").alias("vector"), F.lit(found["absent"] is None).alias("fallback"))


def _phrases(spark, sf):
    p = part_labels(spark, sf)
    text = F.concat(F.lit("Body scrub "), "product_name", F.lit(" - serum "), "brand_name", F.lit(" cream || Review: "), "ocr_text")
    return p.select("item_id", text.alias("ocr_text"))


def phrase_candidates(spark, sf):
    return ex.phrase_candidates(_phrases(spark, sf), "item_id").drop("seq")


def phrase_best(spark, sf):
    return ex.best_phrase(_phrases(spark, sf), "item_id")


def curated_fill_only(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit("")).alias("brand_name"), F.lit("").alias("product_name"), F.col("text").alias("ocr_text"), F.lit("").alias("evidence_text"))
    return ex.curated_fill(docs, _rule_rows(spark, sf), []).select("doc_id", "brand_name", "product_name")


def cascade(spark, sf):
    brands, products = _gazetteers(spark, sf)
    rules = _rule_rows(spark, sf)
    return ex.cascade(_evidence(spark, sf), "item_id", brands, products, _aliases(spark, sf), rules, rules, DEMO_RULES).select("item_id", "brand_name", "product_name")


def _polygon():
    x, y, w, h = (F.col(c) for c in "xywh")
    return F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))


def _json_arrays(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("line_idx", "line_text", "line_score", _polygon().alias("poly"))))
    made = lines(spark, sf).groupBy("doc_id").agg(rows.alias("r"))
    return made.select("doc_id", F.to_json(F.struct(F.struct(F.transform("r", lambda r: r["line_text"]).alias("rec_texts"), F.transform("r", lambda r: r["line_score"]).alias("rec_scores"), F.transform("r", lambda r: r["poly"]).alias("rec_polys")).alias("res"))).alias("json"))


def _json_lists(spark, sf):
    """[[ [polygon, [text, score]], ... ]] put together as text, for a JSON array mixes kinds."""
    one = F.concat(F.lit("["), F.to_json(_polygon()), F.lit(","), F.regexp_replace(F.to_json(F.array("line_text")), r"\]$", ""), F.lit(","), F.col("line_score").cast("string"), F.lit("]]"))
    rows = F.array_sort(F.collect_list(F.struct("line_idx", one.alias("j"))))
    return lines(spark, sf).groupBy("doc_id").agg(F.concat(F.lit("[["), F.array_join(F.transform(rows, lambda r: r["j"]), ","), F.lit("]]")).alias("json"))


_RECORD = ["doc_id", "line_idx", "line_text", "line_score", "box_xmin", "box_ymin", "box_xmax", "box_ymax", "box_width", "box_height", "box_area", "box_cx_ratio", "box_area_ratio"]


def ocr_json_v3(spark, sf):
    return ocr_json.array_records(_json_arrays(spark, sf), "json", ["doc_id"], F.lit(1024), F.lit(2048)).select(*_RECORD)


def ocr_json_v2(spark, sf):
    return ocr_json.nested_records(_json_lists(spark, sf), "json", ["doc_id"], F.lit(1024), F.lit(2048)).select(*_RECORD)


def ocr_json_clean(spark, sf):
    both = ocr_json.records(_json_arrays(spark, sf), "json", ["doc_id"], F.lit(1024), F.lit(2048))
    return ocr_json.clean_records(both, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"))


def variant_geometry(spark, sf):
    sizes = table(spark, sf, "part").select("p_partkey", (300 + F.col("p_size") * 37).cast("int").alias("width"), (200 + F.col("p_partkey") % 50 * 41).cast("int").alias("height"))
    return images.live_geometry(sizes, ["p_partkey"])


def two_head_product_model(spark, sf):
    """Trained and applied on parts: the gate learns which have a product, the classes which."""
    p = part_labels(spark, sf).withColumn("product_name", F.when(F.col("item_id") % 4 == 0, F.lit("")).otherwise(F.regexp_extract("brand_name", r"^(\S+)", 1)))
    return ml.ProductModel().fit(p).predict(p).select("item_id", "predicted_product")


def stream_extract(spark, sf):
    """Parts as a stream of files, extracted once with what is there now; the result is read back."""
    from ..sources.tables import exists

    base = f"{_scratch(spark)}/stream-{uuid.uuid4().hex}"
    made = spread(part_labels(spark, sf)).select("item_id", F.array(F.struct(F.col("ocr_text").alias("text"), F.lit(0.9).alias("score"))).alias("lines"))
    made.write.parquet(f"{base}/in")
    brands, products = _gazetteers(spark, sf)
    source = stream.read_folder(spark, f"{base}/in", "item_id long, lines array<struct<text:string,score:double>>")
    plan = lambda df: stream.extract_stream(stream.joined_lines(df), brands, products, [], [], []).select("item_id", "ocr_text", "brand_name", "product_name")
    stream.run_available(source, plan, f"{base}/out", f"{base}/checkpoint")
    assert exists(spark, f"{base}/out")
    return spark.read.parquet(f"{base}/out")


def _scratch(spark) -> str:
    """The shared folder that the session names; a local one only where it names none and all runs in one process."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"file://{tempfile.mkdtemp()}").rstrip("/")


QUERIES = {f.__name__: f for f in (brand_gazetteer, product_gazetteer, brand_hits, product_gaz_top3, first_match_rules, all_match_rules, regex_first_match, baseline_rules, alias_score_margin, alias_top5, baseline_text, model_bundle, phrase_candidates, phrase_best, curated_fill_only, cascade, ocr_json_v3, ocr_json_v2, ocr_json_clean, variant_geometry, two_head_product_model, stream_extract)}

_SPLIT = r"unnest(list_filter(list_transform(regexp_split_to_array({}, '\s*\+\s*|;|,'), lambda x: trim(x)), lambda x: x != ''))"
_NORMS = f"{PARTS}, names AS (SELECT {_SPLIT.format('product_name')} AS product FROM parts), counted AS (SELECT product, count(*) AS freq FROM names GROUP BY 1), normed AS (SELECT *, {RULE_KEY.format('product')} AS norm FROM counted)"
_CLEAN_GAZ = r"""good AS (SELECT * FROM normed WHERE length(norm) > 3 AND NOT regexp_full_match(norm, '\d+') AND NOT (NOT contains(norm, ' ') AND length(norm) < 5) AND len(list_filter(string_split(norm, ' '), lambda x: length(x) = 1)) < 2),
gaz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY freq DESC, product) AS r FROM good) WHERE r = 1)"""
_BRANDS = rf"""bn AS (SELECT DISTINCT {_SPLIT.format('brand_name')} AS brand FROM parts), bk AS (SELECT brand, {RULE_KEY.format('brand')} AS norm FROM bn),
brands AS (SELECT min(brand) AS brand, norm, replace(norm, ' ', '') AS compact FROM bk WHERE length(norm) >= 2 GROUP BY norm)"""
#: Parts' texts hold letters, digits and spaces alone once they are keys, so a phrase stands free where spaces are around it.
_FOUND_BRANDS = """found_b AS (SELECT item_id, brand, length(norm) AS size, CASE WHEN contains(' ' || n || ' ', ' ' || norm || ' ') THEN instr(' ' || n || ' ', ' ' || norm || ' ') WHEN length(compact) >= 5 THEN instr(replace(n, ' ', ''), compact) ELSE 0 END AS spot FROM keyed, brands),
b AS (SELECT item_id, string_agg(brand, ' + ' ORDER BY spot, size DESC, brand) FILTER (spot > 0) AS brands FROM found_b GROUP BY 1)"""
_FOUND_PRODUCTS = """found_p AS (SELECT item_id, product, norm, contains(' ' || n || ' ', ' ' || norm || ' ')::INT AS exact, (length(norm_packed) >= 6 AND contains(replace(n, ' ', ''), norm_packed))::INT AS inside, freq FROM keyed, (SELECT *, replace(norm, ' ', '') AS norm_packed FROM gaz)),
ranked_p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY 2.0::DOUBLE * exact + 1.7::DOUBLE * inside + least(freq::DOUBLE, 20.0) / 200.0::DOUBLE + least(length(norm), 40) / 100.0::DOUBLE DESC, norm, product) AS r FROM found_p WHERE exact + inside > 0),
free_p AS (SELECT item_id, product, r, row_number() OVER (PARTITION BY item_id ORDER BY r) AS place FROM ranked_p x WHERE NOT EXISTS (SELECT 1 FROM ranked_p y WHERE y.item_id = x.item_id AND y.r < x.r AND contains(y.norm, x.norm))),
p AS (SELECT item_id, string_agg(product, ' + ' ORDER BY r) AS products FROM free_p WHERE place <= 3 GROUP BY 1)"""
_KEYED = "keyed AS (SELECT item_id, ocr_text, {0} AS n FROM parts)"
_TWICE, _ONCE = (_KEYED.format(RULE_KEY.format(c)) for c in ("(ocr_text || ' || ' || ocr_text)", "ocr_text"))
#: Context words without marks: RE2 has boundaries of ASCII words alone, so letters beyond ASCII become one that no word has.
_CONTEXT = r"regexp_matches(translate(lower(text), 'äçèéêíñóöüß', 'qqqqqqqqqqq'), '\b(serum|scrub|mascara|sunscreen|cleanser|cleansing|mousse|cream|wash|mask|spf|body\s*scrub|sua\s*rua\s*mat|tay\s*da\s*chet|k2|d3|dha|colos|baby|kid|gold|grow|profutura|lactoferrin|tra\s*sua|banh|pate|kebab|matcha|roll|sua|milk|ta|bim)\b')"
_RULED = f"{RULES}, r AS (SELECT rule_rank, canonical, {RULE_KEY.format('pattern')} AS a FROM rules), d AS (SELECT *, {RULE_KEY.format('text')} AS n FROM documents)"
_FREE = r"(regexp_matches(n, '(^|[^a-z0-9])' || regexp_replace(a, '([.+&-])', '\\\1', 'g') || '($|[^a-z0-9])') OR (length(regexp_replace(a, '[^a-z0-9]+', '', 'g')) >= 6 AND contains(regexp_replace(n, '[^a-z0-9]+', '', 'g'), regexp_replace(a, '[^a-z0-9]+', '', 'g'))))"
_BOX = "SELECT doc_id, {idx} AS line_idx, line_text, line_score, x::DOUBLE AS box_xmin, y::DOUBLE AS box_ymin, (x + w)::DOUBLE AS box_xmax, (y + h)::DOUBLE AS box_ymax, w::DOUBLE AS box_width, h::DOUBLE AS box_height, (w * h)::DOUBLE AS box_area, (x + x + w) / 2.0::DOUBLE / 1024 AS box_cx_ratio, (w * h)::DOUBLE / (1024 * 2048) AS box_area_ratio FROM lines"
_NUMBERED = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS INT)"
_SCORED = rf"""WITH {_RULED}, a AS (SELECT *, regexp_replace(a, '[^a-z0-9]+', '', 'g') AS c FROM r WHERE length(replace(a, ' ', '')) > 2 AND a NOT IN ({', '.join(repr(x) for x in vc.NO_ALIASES)})),
h AS (SELECT doc_id, rule_rank, canonical, length(c) AS size, {_CONTEXT} AS ctx, CASE WHEN contains(n, a) THEN instr(n, a) - 1 WHEN length(c) >= 6 THEN instr(regexp_replace(n, '[^a-z0-9]+', '', 'g'), c) - 1 ELSE -1 END AS spot FROM d, a WHERE {_FREE}),
s AS (SELECT doc_id, rule_rank, canonical, round(4.0::DOUBLE + CASE WHEN spot < 0 THEN 0 WHEN spot <= 40 THEN 1 WHEN spot <= 100 THEN 0.5 ELSE 0 END + 0.75 + CASE WHEN ctx THEN 0.6 ELSE 0 END + 0.4 + CASE WHEN size >= 6 THEN 0.3 ELSE 0 END - CASE WHEN size <= 3 THEN 1.0 ELSE 0 END, 4) AS s FROM h WHERE size > 3 OR ctx),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, rule_rank) AS k FROM s), f AS (SELECT * FROM o WHERE k = 1), g AS (SELECT o.doc_id, max(o.s) AS s FROM o JOIN f ON o.doc_id = f.doc_id AND o.rule_rank != f.rule_rank GROUP BY 1)"""
ORACLES = {
    "brand_hits": f"WITH {PARTS}, {_BRANDS}, {_TWICE}, {_FOUND_BRANDS} SELECT item_id, coalesce(brands, '') AS brands FROM b",
    "product_gaz_top3": f"WITH {_NORMS}, {_CLEAN_GAZ}, {_TWICE}, {_FOUND_PRODUCTS} SELECT item_id, coalesce(products, '') AS products FROM keyed LEFT JOIN p USING (item_id)",
    "stream_extract": f"WITH {_NORMS}, {_CLEAN_GAZ}, {_BRANDS}, {_ONCE}, {_FOUND_BRANDS}, {_FOUND_PRODUCTS} SELECT item_id, ocr_text, coalesce(brands, '') AS brand_name, coalesce(products, '') AS product_name FROM keyed LEFT JOIN b USING (item_id) LEFT JOIN p USING (item_id)",
    "alias_score_margin": rf"""{_SCORED}
SELECT d.doc_id, CASE WHEN f.s >= 5.0 AND (g.s IS NULL OR f.s - g.s >= 0.5) THEN f.canonical ELSE '' END AS brand_v5, coalesce(f.s, 0.0)::DOUBLE AS brand_v5_score FROM d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN g ON d.doc_id = g.doc_id""",
    "baseline_text": rf"""WITH {LINES}, t AS (SELECT doc_id, coalesce(string_agg(line_text, ' ' ORDER BY y, x, line_idx) FILTER (line_score > 0.35), '') AS s FROM lines GROUP BY 1), w AS (SELECT doc_id, string_split(trim(regexp_replace(s, '\s+', ' ', 'g')), ' ') AS a FROM t)
SELECT doc_id, array_to_string(list_filter(a, lambda v, i: i = 1 OR lower(v) != lower(a[i - 1])), ' ') AS ocr_text FROM w""",
    "model_bundle": f"WITH {PARTS} SELECT item_id, '[' || length(ocr_text)::DOUBLE || ']' AS vector, true AS fallback FROM parts",
    "alias_top5": rf"""{_SCORED}, t AS (SELECT doc_id, string_agg(canonical || ':' || printf('%.2f', s), ' | ' ORDER BY k) AS top FROM o WHERE k <= 5 GROUP BY 1)
SELECT d.doc_id, coalesce(t.top, '') AS brand_v5_top FROM d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "ocr_json_clean": rf"""WITH {LINES}, j AS ({TEXT_ORACLES['junk_line_filter']}), k AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(line_text, '\s+', ' ', 'g'))) AS t FROM lines JOIN j USING (doc_id, line_idx) WHERE NOT junk AND line_score >= 0.45)
SELECT doc_id, count(*) AS n, CAST(count(*) - 1 AS INT) AS last FROM k GROUP BY 1""",
    "brand_gazetteer": rf"""WITH {PARTS}, names AS (SELECT DISTINCT {_SPLIT.format('brand_name')} AS brand FROM parts), k AS (SELECT brand, {RULE_KEY.format('brand')} AS norm FROM names)
SELECT min(brand) AS brand, norm, regexp_replace(norm, '\s+', '', 'g') AS compact, length(norm) AS char_len FROM k WHERE length(norm) >= 2 GROUP BY norm""",
    "product_gazetteer": rf"WITH {_NORMS}, {_CLEAN_GAZ} SELECT product, norm, regexp_replace(norm, '\s+', '', 'g') AS compact, length(norm) AS char_len, freq FROM gaz",
    "first_match_rules": f"WITH {_RULED} SELECT doc_id, (SELECT min_by(canonical, rule_rank) FROM r WHERE a != '' AND {_FREE}) AS rule FROM d",
    "all_match_rules": r"""WITH p AS (SELECT p_partkey AS item_id, ' ' || lower(concat_ws(' ', p_brand, p_type, p_name)) || ' ' AS n FROM part), h AS (SELECT item_id, unnest([{'name': 'STEEL', 'k': 0, 'at': instr(n, ' steel ')}, {'name': 'BRUSHED NICKEL', 'k': 1, 'at': CASE WHEN contains(n, ' brushed nickel ') THEN instr(n, ' brushed nickel ') ELSE instr(n, ' nickel ') END}, {'name': 'TIN', 'k': 2, 'at': instr(n, ' tin ')}, {'name': 'COPPER', 'k': 3, 'at': instr(n, ' copper ')}]) AS h FROM p),
s AS (SELECT item_id, string_agg(h.name, '|' ORDER BY h.at, h.k) FILTER (h.at > 0 AND NOT (h.name = 'TIN' AND steel)) AS rules FROM (SELECT *, bool_or(h.name = 'STEEL' AND h.at > 0) OVER (PARTITION BY item_id) AS steel FROM h) GROUP BY 1) SELECT item_id, coalesce(rules, '') AS rules FROM s""",
    "regex_first_match": r"""WITH p AS (SELECT p_partkey AS item_id, ' ' || lower(concat_ws(' ', p_brand, p_type, p_name)) || ' ' AS n FROM part)
SELECT item_id, CASE WHEN contains(n, ' steel ') THEN 'STEEL' WHEN contains(n, ' nickel ') THEN 'BRUSHED NICKEL' WHEN contains(n, ' tin ') THEN 'TIN' WHEN contains(n, ' copper ') THEN 'COPPER' ELSE '' END AS rule FROM p""",
    "baseline_rules": r"""WITH p AS (SELECT p_partkey AS item_id, lower(concat_ws(' ', p_brand, p_type, p_name)) AS n FROM part)
SELECT item_id, CASE WHEN contains(n, 'steel') THEN 'Steel Works' WHEN contains(n, 'tin') THEN 'Tin Town' WHEN contains(n, 'copper') THEN 'Copper' ELSE '' END AS brand,
CASE WHEN contains(n, 'steel') THEN CASE WHEN contains(n, 'polished') THEN 'Steel Works Polished' WHEN contains(n, 'brushed') THEN 'Steel Works Brushed' ELSE 'Steel Works' END WHEN contains(n, 'tin') THEN CASE WHEN contains(n, 'anodized') THEN 'Tin Town Anodized' ELSE 'Tin Town' END WHEN contains(n, 'copper') THEN 'Copper' ELSE '' END AS product FROM p""",
    "curated_fill_only": f"WITH {_RULED} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE coalesce((SELECT min_by(canonical, rule_rank) FROM r WHERE a != '' AND {_FREE}), '') END AS brand_name, '' AS product_name FROM d",
    "ocr_json_v3": f"WITH {LINES} {_BOX.format(idx=_NUMBERED)}",
    "ocr_json_v2": f"WITH {LINES} {_BOX.format(idx=_NUMBERED)}",
    "variant_geometry": """WITH s AS (SELECT p_partkey, 300 + p_size * 37 AS width, 200 + p_partkey % 50 * 41 AS height FROM part), v(variant, top_, bottom_, side) AS (VALUES """ + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {s})" for n, a, b, s in images.CROPS) + """),
b AS (SELECT p_partkey, variant, width, CAST(floor(top_ * height) AS INT) AS y1, CAST(floor(bottom_ * height) AS INT) AS y2, side FROM s CROSS JOIN v), z AS (SELECT *, greatest(width, y2 - y1) AS m FROM b)
SELECT p_partkey, variant, y1, y2, CAST(CASE WHEN m = side THEN width ELSE greatest(1, floor(width * (side / m::DOUBLE))) END AS INT) AS out_width, CAST(CASE WHEN m = side THEN y2 - y1 ELSE greatest(1, floor((y2 - y1) * (side / m::DOUBLE))) END AS INT) AS out_height FROM z""",
}
