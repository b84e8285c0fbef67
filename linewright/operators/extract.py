"""Brands and products from text: gazetteers and rules, open phrases, scored aliases, curated rules, and their cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, clean, compact_alnum, join_labels, rule_key, split_labels
from .lines import first_by, spread
from .vocabulary import Rule, collected, held_entries

# ---- gazetteers and rules over the rule key -------------------------------------------------------------------------


def _whole(text: Column, phrase: Column) -> Column:
    """1-based place of a phrase between word boundaries, 0 if none; the pattern is compiled only where the text holds it."""
    return F.when(F.contains(text, phrase), F.regexp_instr(text, F.concat(F.lit(r"\b\Q"), phrase, F.lit(r"\E\b")))).otherwise(F.lit(0))


def held_brands(norm: Column, packed: Column, gazetteer: list) -> Column:
    return held_entries(norm, packed, gazetteer, "norm", "compact", 5, brand="string", norm="string", compact="string", char_len="int")


def held_products(norm: Column, packed: Column, gazetteer: list) -> Column:
    return held_entries(norm, packed, gazetteer, "norm", "compact", 6, product="string", norm="string", compact="string", char_len="int", freq="double")


def held_rules(norm: Column, packed: Column, rules: list) -> Column:
    return held_entries(norm, packed, rules, "alias_norm", "alias_compact", 6, rule_rank="long", canonical="string", alias_norm="string", alias_compact="string")


def brand_hits(norm: Column, packed: Column, entries: Column) -> Column:
    """Names found (of ``held_brands``), by place, then longer first; hits of the packed form (5 characters or more) have places in it."""
    placed = F.transform(entries, lambda g: F.struct(_whole(norm, g["norm"]).alias("whole"), F.when(F.length(g["compact"]) >= 5, F.instr(packed, g["compact"])).otherwise(F.lit(0)).alias("packed"), g.alias("g")))
    hits = F.transform(placed, lambda p: F.struct(F.when(p["whole"] > 0, p["whole"]).otherwise(p["packed"]).alias("at"), (-p["g"]["char_len"]).alias("n"), p["g"]["brand"].alias("brand")))
    return F.transform(F.array_sort(F.filter(hits, lambda h: h["at"] > 0)), lambda h: h["brand"])


def product_hits(norm: Column, packed: Column, entries: Column, most: int = 3) -> Column:
    """The best names found (of ``held_products``): exact 2.0, packed (6 or more) 1.7, up to 0.1 for frequency and 0.4 for length; a name inside one chosen before it is skipped."""
    placed = F.transform(entries, lambda g: F.struct((_whole(norm, g["norm"]) > 0).cast("int").alias("exact"), ((F.length(g["compact"]) >= 6) & F.contains(packed, g["compact"])).cast("int").alias("inside"), g.alias("g")))
    scored = F.transform(placed, lambda p: F.struct((-(2.0 * p["exact"] + 1.7 * p["inside"] + F.least(p["g"]["freq"], F.lit(20.0)) / 200.0 + F.least(p["g"]["char_len"], F.lit(40)) / 100.0)).alias("s"), p["g"]["norm"].alias("norm"), p["g"]["product"].alias("product"), (p["exact"] + p["inside"]).alias("hit")))
    found = F.array_sort(F.filter(scored, lambda s: s["hit"] > 0))
    none = F.array().cast("array<struct<s:double,norm:string,product:string,hit:int>>")
    return F.aggregate(found, none, lambda got, x: F.when((F.size(got) >= most) | F.exists(got, lambda y: F.contains(y["norm"], x["norm"])), got).otherwise(F.concat(got, F.array(x))), lambda got: F.transform(got, lambda x: x["product"]))


def rule_products(norm: Column, rules: list[Rule], suppressed: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Products of all rules that match, by the place of the first pattern that does, without those that others suppress."""
    if not rules:
        return F.array().cast("array<string>")
    places = [F.coalesce(*(F.when(F.regexp_instr(norm, F.lit(p)) > 0, F.regexp_instr(norm, F.lit(p))) for p in r.patterns)) for r in rules]
    hits = F.array_sort(F.array_compact(F.array(*(F.when(p.isNotNull(), F.struct(p.alias("at"), F.lit(k).alias("k"), F.lit(r.canonical).alias("name"))) for k, (p, r) in enumerate(zip(places, rules))))))
    names = F.array_distinct(F.transform(hits, lambda h: h["name"]))
    for name, others in (suppressed or {}).items():
        names = F.when(F.arrays_overlap(names, F.array(*map(F.lit, others))), F.array_remove(names, name)).otherwise(names)
    return names


def first_rule(text: Column, rules: list[Rule]) -> Column:
    """The canonical name of the first rule with a pattern in the text, else null: order is meaning."""
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.when(text.rlike("(?i)(?:" + ")|(?:".join(r.patterns) + ")"), F.lit(r.canonical)) for r in rules))


def baseline_product(text: Column, rules: list[Rule]) -> Column:
    """struct(brand, product): the first rule's brand, and with it the first of its lines that the text holds, in title case."""
    low = F.replace(F.lower(text), F.lit("patê"), F.lit("pate"))
    chosen = []
    for r in rules:
        line = F.coalesce(*(F.when(low.rlike(f"(?i){x}"), F.concat(F.lit(r.canonical + " "), F.initcap(F.lit(x)))) for x in r.lines), F.lit(r.canonical))
        chosen.append(F.when(low.rlike("(?i)(?:" + ")|(?:".join(r.patterns) + ")"), F.struct(F.lit(r.canonical).alias("brand"), line.alias("product"))))
    return F.coalesce(*chosen, F.struct(F.lit("").alias("brand"), F.lit("").alias("product")))


def rulebase(df: DataFrame, brands: list, products: list, rules: list[Rule] = [], suppressed: dict | None = None, text: str = "evidence_text") -> DataFrame:  # noqa: B006
    """Adds brand_v3 and product_v3: gazetteer brands; products of rules, then of the gazetteer, split and joined again."""
    df = df.withColumns({"_norm": rule_key(F.col(text))}).withColumn("_packed", F.regexp_replace("_norm", r"\s+", ""))
    norm, packed = F.col("_norm"), F.col("_packed")
    df = df.withColumns({"_brands": held_brands(norm, packed, brands), "_products": held_products(norm, packed, products)})
    found = F.flatten(F.transform(F.concat(rule_products(norm, rules, suppressed), product_hits(norm, packed, F.col("_products"))), split_labels))
    return df.withColumns({"brand_v3": join_labels(brand_hits(norm, packed, F.col("_brands"))), "product_v3": join_labels(found)}).drop("_norm", "_packed", "_brands", "_products")


# ---- curated rules: aliases in evidence, filling blanks only --------------------------------------------------------


def holds_alias(norm: Column, packed: Column, alias_norm: Column, alias_packed: Column) -> Column:
    """The alias stands free of letters and digits around it, or its packed form (6 or more) is inside."""
    free = F.contains(norm, alias_norm) & (F.regexp_instr(norm, F.concat(F.lit(r"(?<![a-z0-9])\Q"), alias_norm, F.lit(r"\E(?![a-z0-9])"))) > 0)
    return (alias_norm != "") & ((F.when(F.contains(norm, alias_norm), free).otherwise(F.lit(False))) | ((F.length(alias_packed) >= 6) & F.contains(packed, alias_packed)))


def first_alias_rule(norm: Column, packed: Column, entries: Column) -> Column:
    """Of rows (rule_rank, canonical, alias_norm, alias_compact; of ``held_rules``) the name of the lowest rank whose alias the text holds."""
    hits = F.filter(entries, lambda r: holds_alias(norm, packed, r["alias_norm"], r["alias_compact"]))
    return F.get(F.array_sort(F.transform(hits, lambda r: F.struct(r["rule_rank"].alias("k"), r["canonical"].alias("name")))), F.lit(0))["name"]


def rule_rows(rules: list[Rule], spark) -> list:
    rows = [(k, r.canonical, a) for k, r in enumerate(rules) for a in r.patterns]
    df = spark.createDataFrame(rows, "rule_rank long, canonical string, alias string")
    return collected(df.select("rule_rank", "canonical", rule_key(F.col("alias")).alias("alias_norm"), compact_alnum(F.col("alias")).alias("alias_compact")))


def curated_fill(df: DataFrame, brand_rules: list, product_rules: list, brand: str = "brand_name", product: str = "product_name", text: str = "ocr_text", evidence: str = "evidence_text") -> DataFrame:
    """Fills blank brands and products by the first rule over text and evidence; adds *_rule, the name each rule set gave."""
    both = clean(F.concat_ws(" || ", F.coalesce(text, F.lit("")), F.coalesce(evidence, F.lit(""))))
    df = df.withColumns({"_norm": rule_key(both)}).withColumn("_packed", F.regexp_replace("_norm", "[^a-z0-9]+", ""))
    out = df.withColumns({"_held_brand_rule": held_rules(F.col("_norm"), F.col("_packed"), brand_rules), "_held_product_rule": held_rules(F.col("_norm"), F.col("_packed"), product_rules)})
    for c, named in ((brand, "brand_rule"), (product, "product_rule")):
        old = F.coalesce(F.col(c), F.lit(""))
        out = out.withColumn(named, F.when(F.trim(old) == "", F.coalesce(first_alias_rule(F.col("_norm"), F.col("_packed"), F.col(f"_held_{named}")), F.lit(""))).otherwise(F.lit("")))
        out = out.withColumn(c, F.when(F.col(named) != "", F.col(named)).otherwise(old))
    return out.drop("_norm", "_packed", "_held_brand_rule", "_held_product_rule")


# ---- scored aliases ---------------------------------------------------------------------------------------------------

# Words around which a brand is likelier.
BRAND_CONTEXT = r"(?iU)\b(serum|scrub|mascara|sunscreen|cleanser|cleansing|mousse|cream|wash|mask|spf|body\s*scrub|sữa\s*rửa\s*mặt|sua\s*rua\s*mat|tẩy\s*da\s*chết|tay\s*da\s*chet|k2|d3|dha|colos|baby|kid|gold|grow|profutura|lactoferrin|trà\s*sữa|tra\s*sua|bánh|banh|pate|kebab|matcha|roll|sữa|sua|milk|tã|ta|bỉm|bim)\b"


def alias_brand(df: DataFrame, aliases: list, threshold: float = 5.0, margin: float = 0.5, text: str = "ocr_text", evidence: str = "evidence_text") -> DataFrame:
    """Adds brand_v5 and brand_v5_score: the best-scored name if it reaches the threshold and leads by the margin; and
    brand_v5_top, the five best names with their scores.

    An alias must be in the text itself to reach any sensible threshold, so others are not scored.
    ``aliases``: rows (canonical_ord, canonical, alias_ord, alias_norm, alias_compact).
    """
    near = lambda c: F.coalesce(F.col(c).rlike(BRAND_CONTEXT), F.lit(False))
    same = F.col(text).eqNullSafe(F.col(evidence))  # then nothing is made twice
    df = df.withColumns({"_n": rule_key(F.col(text)), "_ctx": near(text) | (~same & near(evidence))})
    df = df.withColumns({"_p": F.regexp_replace("_n", "[^a-z0-9]+", ""), "_e": F.when(same, F.col("_n")).otherwise(rule_key(F.col(evidence)))})
    df = df.withColumn("_ep", F.when(same, F.col("_p")).otherwise(F.regexp_replace("_e", "[^a-z0-9]+", "")))
    df = df.withColumn("_held", held_entries(F.col("_n"), F.col("_p"), aliases, "alias_norm", "alias_compact", 6, canonical_ord="long", canonical="string", alias_ord="long", alias_norm="string", alias_compact="string"))
    hits = F.filter("_held", lambda a: holds_alias(F.col("_n"), F.col("_p"), a["alias_norm"], a["alias_compact"]))

    def scored(a: Column) -> Column:
        size = F.length(a["alias_compact"])
        at = F.when(F.contains(F.col("_n"), a["alias_norm"]), F.instr(F.col("_n"), a["alias_norm"]) - 1).when(size >= 6, F.instr(F.col("_p"), a["alias_compact"]) - 1).otherwise(F.lit(-1))
        near = F.when(at < 0, 0.0).when(at <= 40, 1.0).when(at <= 100, 0.5).otherwise(0.0)
        seen = holds_alias(F.col("_e"), F.col("_ep"), a["alias_norm"], a["alias_compact"])
        score = 4.0 + near + F.when(seen, 0.75).otherwise(0.0) + F.when(F.col("_ctx"), 0.6).otherwise(0.0) + 0.4 + F.when(size >= 6, 0.3).otherwise(0.0)
        score = F.when(size <= 3, F.when(seen & F.col("_ctx"), score - 1.0).otherwise(-999.0)).otherwise(score)
        return F.struct((-F.round(score, 4)).alias("s"), a["canonical_ord"].alias("c"), a["alias_ord"].alias("a"), a["canonical"].alias("name"))

    ranked = F.array_sort(F.filter(F.transform(hits, scored), lambda x: x["s"] < 100))
    df = df.withColumn("_r", ranked).withColumn("_first", F.get("_r", F.lit(0)))
    df = df.withColumn("_second", F.get(F.filter("_r", lambda x: x["c"] != F.col("_first")["c"]), F.lit(0)))
    names = F.filter("_r", lambda x, i: F.array_position(F.transform("_r", lambda y: y["c"]), x["c"]) == i + 1)
    top = F.array_join(F.transform(F.slice(names, 1, 5), lambda x: F.concat_ws(":", x["name"], F.format_number(-x["s"], 2))), " | ")
    best, next_best = -F.col("_first")["s"], -F.col("_second")["s"]
    sure = (best >= threshold) & (F.col("_second").isNull() | (best - next_best >= margin))
    return df.withColumns({"brand_v5": F.when(sure, F.col("_first")["name"]).otherwise(F.lit("")), "brand_v5_score": F.coalesce(best, F.lit(0.0)), "brand_v5_top": top}).drop("_n", "_e", "_ctx", "_p", "_ep", "_held", "_r", "_first", "_second")


# ---- open product phrases ---------------------------------------------------------------------------------------------

# The words that the phrase score is defined by.
TOKEN = r"[A-Za-zÀ-ỹ0-9][A-Za-zÀ-ỹ0-9+\-/]*"
PRICE = r"(?iU)(\b\d{1,3}([.,]\d{3})+\b|\b\d+\s*(k|đ|d|vnd|vnđ)\b)"
PHONE = r"\b0\d{8,10}\b"
ADDRESS = r"(?iU)\b(www\.|http|\.com|facebook|tiktok|shopee|lazada|zalo|youtube|instagram)\b"
PROMOTION = r"(?iU)\b(sale|deal|voucher|freeship|free\s*ship|ship|review|viral|tiktok|giảm|giam|giá|gia|mua|bán|ban|tặng|tang|quà|qua|chính\s*hãng|chinh\s*hang|mẫu\s*mới|mau\s*moi|hàng\s*mới|hang\s*moi|hot|new|follow|like|share|livestream|video|clip|giao\s*nhanh|miễn\s*phí|mien\s*phi|trả\s*góp|tra\s*gop|cam\s*kết|camket|độc\s*quyền|doc\s*quyen)\b"
CAPTION = r"(?iU)\b(tôi|toi|mình|minh|bạn|ban|nó|no|này|nay|kia|đó|do|không|khong|ko|k|chưa|chua|rồi|roi|sao|vậy|zay|vay|một|mot|buổi|buoi|chiều|chieu|sáng|sang|tối|toi|hôm\s*nay|hom\s*nay|là|la|khi|lúc|luc|cần|can|thấy|thay|ăn|an|uống|uong|ngon|quá|qua|thích|thich|bắt\s*lực|bat\s*luc|tuyệt\s*tác|tuyet\s*tac|hoàng\s*hôn|hoang\s*hon)\b"
CONTACT = r"(?iU)\b(shop|store|official|địa\s*chỉ|dia\s*chi|liên\s*hệ|lien\s*he|inbox|comment|ib|sdt|hotline|nguồn|source|ảnh|photo|cửa\s*hàng|cua\s*hang|thông\s*minh|thong\s*minh)\b"
PRODUCT_CUE = r"(?iU)\b(bánh|banh|trà|tra|sữa|sua|milk|tea|coffee|cafe|cà\s*phê|ca\s*phe|matcha|roll|combo|kebab|phô\s*mai|pho\s*mai|trứng|trung|mực|muc|khô|kho|gà|ga|bò|bo|heo|pate|pat[eê]|xúc\s*xích|xuc\s*xich|chả|cha|nem|scrub|serum|cleanser|cleansing|mousse|mascara|sunscreen|toner|cream|gel|wash|mask|spf|body\s*wash|shampoo|arbutin|vitamin\s*c|tẩy\s*da\s*chết|tay\s*da\s*chet|sữa\s*rửa\s*mặt|sua\s*rua\s*mat|kem\s*chống\s*nắng|kem\s*chong\s*nang|dầu\s*gội|dau\s*goi|sữa\s*tắm|sua\s*tam|k2|d3|dha|canxi|colos|baby|kid|gold|grow|profutura|lactoferrin|máy\s*đo|may\s*do|đường\s*huyết|duong\s*huyet|túi\s*đựng|tui\s*dung)\b"
NO_PHRASES = ["", "san pham", "thuc pham", "my pham", "do an", "mon ngon", "breaking news", "tin hot", "top", "best", "hang moi", "mau moi", "chinh hang", "gia re", "gia soc"]
FILLERS = ["review", "tiktok", "viral", "sale", "deal", "voucher", "freeship", "free", "ship", "chinh", "hang", "mau", "moi", "hot", "new", "mua", "ban", "gia", "giam", "tang", "qua", "video", "clip", "shop", "store", "official", "tot", "nhat", "cua", "cho", "voi", "khong", "khongg", "ko", "roi", "sao", "vay", "zay", "toi", "minh", "mot", "buoi", "chieu", "hom", "nay", "ho", "tro", "cuong", "de", "khang"]
CAPTION_EXCUSE = r"(?iU)\b(serum|mascara|scrub|sunscreen|cleanser|mousse|body|spf|k2|d3)\b"
CARE_WORD = r"(?iU)\b(serum|mascara|scrub|sunscreen|cleanser|mousse|body|spf|cream|wash|mask)\b"
FOOD_WORD = r"(?iU)\b(bánh|banh|trà|tra|matcha|roll|combo|kebab|pate)\b"
_W, _W2 = r"(?:\s+[a-zA-ZÀ-ỹ0-9+\-/]{1,})", r"[a-zA-ZÀ-ỹ0-9+\-/]{2,}"
KNOWN = [rf"(?iU)\b{p}" for p in (
    r"body\s*scrub\b", rf"{_W2}\s+serum\b{_W}{{0,4}}", rf"serum\b{_W}{{1,5}}", rf"{_W2}\s+mascara\b{_W}{{0,4}}", r"cleansing\s+mousse\b", r"facial\s+cleansing\s+mousse\b",
    rf"sữa\s+rửa\s+mặt\b{_W}{{0,4}}", rf"sua\s+rua\s+mat\b{_W}{{0,4}}", r"matcha\s+roll\b", rf"trà\s+sữa\b{_W}{{0,3}}", rf"tra\s+sua\b{_W}{{0,3}}", rf"bánh\b{_W}{{1,6}}", rf"banh\b{_W}{{1,6}}",
)]
_EDGE = " -–—.,:;()[]{}"


def without_brands(c: Column, brands: Column) -> Column:
    return clean(F.aggregate(split_labels(brands), clean(c), lambda s, b: F.regexp_replace(s, F.concat(F.lit(r"(?iU)\b\Q"), b, F.lit(r"\E\b")), F.lit(" "))))


def segments(c: Column) -> Column:
    """Parts of a text between line ends, bullets and punctuation, of 3 characters or more."""
    rough = F.filter(F.transform(F.split(F.replace(clean(c), F.lit("||"), F.lit("\n")), r"[\n\r]+|[•✓·]+"), clean), lambda p: F.length(p) >= 3)
    cut = lambda rough: F.filter(F.transform(F.flatten(F.transform(rough, lambda p: F.split(p, r"[-–—,:;(){}\[\]]+"))), clean), lambda p: F.length(p) >= 3)
    return bound(rough, lambda rough: bound(cut(rough), lambda fine: F.when(F.size(fine) > 0, fine).otherwise(rough)))


def bare_phrase(c: Column) -> Column:
    """A phrase up to the first address or price, without phone numbers, handles, odd punctuation and promotion."""

    def before(s: Column, pattern: str, least: int) -> Column:
        return bound(F.struct(s.alias("s"), F.regexp_instr(s, F.lit(pattern)).alias("at")), lambda x: F.when(x["at"] > least, F.substring(x["s"], F.lit(1), x["at"] - 1)).otherwise(x["s"]))

    s = bound(bound(clean(c), lambda s: before(s, ADDRESS, 0)), lambda s: before(s, PRICE, 3))
    for pattern in (PHONE, r"(?U)[@#]\S+", "[|:;,_]+"):
        s = F.regexp_replace(s, pattern, " ")
    s = F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(_EDGE))
    return F.btrim(F.regexp_replace(F.regexp_replace(s, PROMOTION, " "), r"(?U)\s+", " "), F.lit(_EDGE))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(clean(c), F.lit(f"({TOKEN})"), 1)


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_soup(c: Column) -> Column:
    """Scraps of misread text: short tokens, tokens without vowels, odd characters."""
    # where words of ASCII letters and digits stand alone, their keys are their small letters
    keys = F.when(c.rlike("^[A-Za-z0-9]+( [A-Za-z0-9]+)*$"), F.split(F.lower(c), " ")).otherwise(F.filter(F.transform(tokens(c), rule_key), lambda t: t != ""))

    def judged(own: Column) -> Column:
        n, one, two = F.size(own), F.size(F.filter(own, lambda t: F.length(t) <= 1)), F.size(F.filter(own, lambda t: F.length(t) <= 2))
        vowels = F.aggregate(own, F.lit(0.0), lambda a, t: a + F.when(t.rlike("[aeiouyăâêôơư]"), 1.0).when(t.rlike(r"\d"), 0.5).otherwise(0.0)) / n
        return (n == 0) | ((n >= 4) & (one >= 2)) | ((n >= 6) & (two / n >= 0.55)) | (vowels < 0.55)

    return bound(keys, judged) | (_count(c, r"(?U)[^A-Za-zÀ-ỹ0-9\s+\-/]") >= 3)


def is_bad_phrase(c: Column, norm: Column) -> Column:
    """No product name: ``c`` is bare already and ``norm`` its rule key."""
    some = norm.isin(NO_PHRASES) | ~F.length(c).between(4, 70) | ~c.rlike("[A-Za-zÀ-ỹ]")

    def counted(x: Column) -> Column:
        n, filler, digits, captions = (x[k] for k in ("n", "filler", "digits", "captions"))
        return (
            ~n.between(2, 9) | (filler / n >= 0.35) | (captions >= 2) | (digits >= F.greatest(F.lit(2), F.floor(n / 2))) | ((captions >= 1) & ~c.rlike(CAPTION_EXCUSE))
            | c.rlike(PHONE) | c.rlike(ADDRESS) | is_soup(c) | (c.rlike(CONTACT) & ~c.rlike(PRODUCT_CUE))
        )

    filler, digits = lambda t: t.isin(FILLERS), lambda t: t.rlike(r"^\d+$")
    counts = lambda own: F.struct(F.size(own).alias("n"), F.size(F.filter(own, filler)).alias("filler"), F.size(F.filter(own, digits)).alias("digits"), _count(c, CAPTION).alias("captions"))
    return some | bound(bound(F.split(norm, " "), counts), counted)


def phrase_marks(c: Column, norm: Column) -> Column:
    """What the score of a phrase is made of, wherever it stands."""
    own = F.split(norm, " ")
    marks = {"cue": c.rlike(PRODUCT_CUE), "promotion": c.rlike(PROMOTION), "care": c.rlike(CARE_WORD), "food": c.rlike(FOOD_WORD)}
    return F.struct(F.size(own).alias("n"), _count(c, CAPTION).alias("captions"), F.size(F.filter(own, lambda t: t.isin(FILLERS))).alias("filler"), *(v.alias(k) for k, v in marks.items()))


def phrase_score(marks: Column, rank: Column, source: Column) -> Column:
    n, captions = marks["n"], marks["captions"]
    score = F.when(n.between(2, 5), 1.6).when(n.between(6, 8), 0.8).otherwise(-1.0) + F.when(marks["cue"], 2.4).otherwise(0.0) + F.greatest(F.lit(0.0), 0.7 - 0.07 * rank)
    score = score + F.when(source == 0, 1.3).when(source == 1, 0.8).otherwise(0.4) - F.when(marks["promotion"], 1.0).otherwise(0.0) - captions * 0.8 - marks["filler"] * 0.5
    return F.round(score + F.when(marks["care"], 0.8).otherwise(0.0) + F.when(marks["food"] & (captions == 0), 0.6).otherwise(0.0), 4)


_PHRASES = "array<struct<source:int,seq:bigint,phrase:string>>"


def segment_phrases(seg: Column) -> Column:
    """source, seq and phrase of all that a bare segment may name, in their order."""
    item = lambda source, seq, phrase: F.struct(F.lit(source).alias("source"), seq.cast("long").alias("seq"), phrase.alias("phrase"))
    matches = lambda k, p: F.transform(F.regexp_extract_all(seg, F.lit(p), 0), lambda x, i: item(0, F.lit(k * 1_000_000) + i, x))
    none = F.array().cast(_PHRASES)

    def of_tokens(t: Column) -> Column:
        def around(i: Column) -> Column:
            def from_start(start: Column) -> Column:
                stop = F.least(F.size(t), start + 7)
                return F.when(stop >= i + 2, F.transform(F.sequence(i + 2, F.greatest(stop, i + 2)), lambda end: item(1, (i.cast("long") * 100 + start - i + 50) * 100 + end - i, F.array_join(F.slice(t, start + 1, end - start), " ")))).otherwise(none)

            return F.flatten(F.transform(F.sequence(F.greatest(F.lit(0), i - 2), i), from_start))

        cues = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i).rlike(PRODUCT_CUE))
        windows = F.when(F.size(t) > 0, F.flatten(F.transform(cues, around))).otherwise(none)
        return F.concat(windows, F.when(F.size(t).between(2, 7), F.array(item(2, F.lit(0), seg))).otherwise(none))

    return F.concat(*(matches(k, p) for k, p in enumerate(KNOWN)), bound(tokens(seg), of_tokens))


def judged_phrases(seg: Column, brand: Column) -> Column:
    """source, seq, phrase, norm and marks of all phrases of a segment that may be names; each step is made once for a phrase."""
    bare = lambda x: F.struct(x["source"], x["seq"], bare_phrase(x["phrase"]).alias("phrase"))
    keyed = lambda x: F.struct(x["source"], x["seq"], x["phrase"], rule_key(x["phrase"]).alias("norm"))
    marked = lambda x: F.struct(x["source"], x["seq"], x["phrase"], x["norm"], phrase_marks(x["phrase"], x["norm"]).alias("marks"))

    def judged(s: Column) -> Column:
        made = F.transform(F.transform(segment_phrases(s), bare), keyed)
        return F.when((s != "") & s.rlike(PRODUCT_CUE), F.transform(F.filter(made, lambda x: ~is_bad_phrase(x["phrase"], x["norm"])), marked))

    return bound(bare_phrase(without_brands(seg, brand)), judged)


def phrase_candidates(df: DataFrame, key: str, text: str = "ocr_text", brand: str | None = None) -> DataFrame:
    """key, phrase, norm, source (0 known pattern, 1 window around a cue, 2 whole segment), rank, seq and score: the first of each norm.

    Phrases are looked for once in each different segment, in tasks of their own whatever the files are cut into.
    """
    split = df.select(key, F.coalesce(brand, F.lit("")).alias("_brand") if brand else F.lit("").alias("_brand"), F.posexplode(segments(F.col(text))).alias("rank", "_seg"))
    once = spread(split.select("_brand", "_seg").distinct())
    found = once.select("_brand", "_seg", F.explode(judged_phrases(F.col("_seg"), F.col("_brand"))).alias("_c")).select("_brand", "_seg", "_c.*")
    made = split.join(found, ["_brand", "_seg"]).select(key, "rank", "source", "seq", "phrase", "norm", "marks").repartition(key)
    made = first_by(made, [key, "norm"], F.asc("rank"), F.asc("source"), F.asc("seq"))
    return made.select(key, "rank", "source", "seq", "phrase", "norm", phrase_score(F.col("marks"), F.col("rank"), F.col("source")).alias("score"))


def best_phrase(df: DataFrame, key: str, threshold: float = 6.3, text: str = "ocr_text", brand: str | None = None) -> DataFrame:
    """key, product_v4 (empty below the threshold) and product_v4_score of items with any candidate."""
    order = F.struct((-F.col("score")).alias("a"), "rank", "source", "seq")
    best = phrase_candidates(df, key, text, brand).groupBy(key).agg(F.min_by(F.struct("phrase", "score"), order).alias("_b")).select(key, "_b.*")
    return best.select(key, F.when(F.col("score") >= threshold, F.col("phrase")).otherwise(F.lit("")).alias("product_v4"), F.col("score").alias("product_v4_score"))


# ---- the cascade --------------------------------------------------------------------------------------------------------


def cascade(df: DataFrame, key: str, brands: list, products: list, aliases: list, brand_rules: list, product_rules: list, rules: list[Rule] = [], suppressed: dict | None = None, phrase_threshold: float = 6.3, alias_threshold: float = 5.0, margin: float = 0.5) -> DataFrame:  # noqa: B006
    """key, ocr_text, brand_name, product_name and what each stage said; later stages only fill what is still blank.

    ``df``: key, ocr_text, evidence_text.
    """
    out = rulebase(df, brands, products, rules, suppressed)
    open_items = out.where((F.col("product_v3") == "") & (F.col("ocr_text") != ""))
    out = out.join(best_phrase(open_items, key, phrase_threshold, brand="brand_v3"), key, "left")
    out = alias_brand(out, aliases, alias_threshold, margin)
    filled = lambda *cs: F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in cs), F.lit(""))
    out = out.withColumns({"brand_name": filled("brand_v3", "brand_v5"), "product_name": filled("product_v3", "product_v4")})
    return curated_fill(out, brand_rules, product_rules)
