"""Counts and ratios over recognised text, in three profiles that differ in what counts and by what they divide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import no_text, trimmed
from .text import ACCENTED, bound, clean, null_to_empty

# Letters with Vietnamese marks; symbols that a sound line may hold.
ACCENTS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴÈÉẸẺẼÊỀẾỆỂỄÌÍỊỈĨÒÓỌỎÕÔỒỐỘỔỖƠỜỚỢỞỠÙÚỤỦŨƯỪỨỰỬỮỲÝỴỶỸĐ"
SOUND_SYMBOLS = r"Ạ\-ỹ+/&%.,:()"
LINE_LETTERS = "a-zA-ZÀ-ỹĐđ"
LOWER_ACCENTS = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđĐ"

PROFILES = ("live", "lcf", "router")


def char_class(letters: str) -> str:
    """A class of these characters for a pattern, in runs: a class that lists them is a chain of tests, one for each, at every
    character of a text. Characters below the first one are ruled out at once."""
    points = sorted(set(map(ord, letters)))
    begins = [p for k, p in enumerate(points) if not k or points[k - 1] + 1 < p]
    ends = [p for k, p in enumerate(points) if k + 1 == len(points) or points[k + 1] > p + 1]
    return f"[{chr(points[0])}-{chr(points[-1])}&&[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(begins, ends)) + "]]"


ACCENT_CLASS, LOWER_ACCENT_CLASS = char_class(ACCENTS), char_class(LOWER_ACCENTS)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars(c: Column, kind: str) -> Column:
    """How many characters a class has: runs are cut out whole, which is far cheaper than a match for each."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{kind if kind.startswith('[') else f'[{kind}]'}+", ""))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def spaced(s: Column) -> Column:
    """The words of a text that single spaces divide."""
    return F.when(s == "", F.lit(0)).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)


def words(c: Column) -> Column:
    return count(c, r"(?U)\S+")


def holds_text(c: Column) -> Column:
    """Anything but white space, which is looked for no further than to the first such character."""
    return c.rlike(r"(?U)\S")


def _measured(c: Column, profile: str) -> dict[str, Column]:
    """The text in the form that the profile measures."""
    return {"s": {"live": clean(c), "lcf": trimmed(c), "router": null_to_empty(c)}[profile], "blank": no_text(c) if profile == "lcf" else ~holds_text(null_to_empty(c))}


def _counts(s: Column, profile: str) -> dict[str, Column]:
    """What is counted in it, each class once."""
    out = {"n": F.length(s), "dot": F.contains(s, F.lit(".")).cast("int"), "plus": F.contains(s, F.lit("+")).cast("int"), "alpha": chars(s, r"\p{L}"), "digit": chars(s, r"\p{Nd}"), "upper": chars(s, r"\p{Lu}"), "accent": chars(s, ACCENTED if profile == "lcf" else ACCENT_CLASS)}
    out["words"] = spaced(s) if profile == "live" else words(s)
    if profile == "router":
        lines = F.filter(F.split(s, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), holds_text)
        sound = rf"[0-9A-Za-z{ACCENTED}\s.,\-+/:%&()]+"  # what is left without it: a negated class of so many ranges takes six times as long
        return out | {"bad": F.length(F.regexp_replace(s, sound, "")), "lines": F.size(lines), "spaces": chars(s, r"\s\p{IsWhite_Space}")}
    return out | {"bad": chars(s, rf"^\p{{L}}\p{{N}}\s\p{{IsWhite_Space}}{SOUND_SYMBOLS if profile == 'live' else ACCENTED}")}


def _derived(blank: Column, of: dict[str, Column], profile: str) -> dict[str, Column]:
    n, alpha, digit, upper, accent = (of[k] for k in ("n", "alpha", "digit", "upper", "accent"))
    by = {"live": alpha, "router": alpha, "lcf": F.greatest(n, F.lit(1))}[profile]
    size = F.greatest(n, F.lit(1)) if profile == "lcf" else n
    out = {"digit_count": digit, "alpha_count": alpha, "upper_count": upper, "accent_count": accent}
    out |= {"digit_ratio": ratio(digit, size), "alpha_ratio": ratio(alpha, size), "upper_ratio": ratio(upper, by), "accent_ratio": ratio(accent, by), "word_count": of["words"]}
    if profile == "router":
        out |= {"junk_ratio": ratio(of["bad"], n), "text_len": n, "line_count_text": of["lines"], "space_count": of["spaces"], "junk_count": of["bad"]}
        return out | {"avg_word_len": ratio(n, of["words"]), "is_blank_pred": blank.cast("int")}
    out["junk_ratio"] = F.when(n == 0, F.lit(1.0 if profile == "live" else 0.0)).otherwise(1.0 - (n - of["bad"]) / n)
    out |= {"text_len": n, "char_count": n, "has_digit": (digit > 0).cast("int"), "has_accent": (accent > 0).cast("int"), "has_dot": (of["dot"] > 0).cast("int"), "has_plus": (of["plus"] > 0).cast("int")}
    return out | {"is_blank": (blank if profile == "lcf" else n == 0).cast("int")}


def text_features(c: Column, profile: str = "live") -> dict[str, Column]:
    """The features by name. live: cleaned text, upper and accent shares of letters. lcf: trimmed text, all shares of
    characters. router: untouched text, upper and accent shares of letters."""
    form = _measured(c, profile)
    return _derived(form["blank"], _counts(form["s"], profile), profile)


def with_text_features(df: DataFrame, text: str, profile: str = "live", only: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the features (or ``only`` some of them); the measured form and each count are made once for a row."""
    df = df.withColumns({f"_form_{k}": c for k, c in _measured(F.col(text), profile).items()})
    counts = _counts(F.col("_form_s"), profile)
    df = df.withColumns({f"_count_{k}": c for k, c in counts.items()})
    made = _derived(F.col("_form_blank"), {k: F.col(f"_count_{k}") for k in counts}, profile)
    return df.withColumns({k: made[k] for k in only or made}).drop("_form_s", "_form_blank", *(f"_count_{k}" for k in counts))


def line_counts(line: Column, profile: str) -> dict[str, Column]:
    """Of a cleaned line, what ``joined_features`` adds up."""
    return _counts(line, profile) | {"null": no_text(line).cast("int")}


def joined_features(of: dict[str, Column], n_lines: Column, profile: str) -> dict[str, Column]:
    """The features (live or lcf) of lines that hold text, joined by spaces, from sums of their counts: no text is read again."""
    whole = lambda name: F.coalesce(of[name], F.lit(0)).cast("int")
    counts = {k: whole(k) for k in of} | {"n": F.when(n_lines > 0, whole("n") + n_lines - 1).otherwise(F.lit(0))}
    return _derived((n_lines == 0) | (n_lines == 1) & (counts["null"] > 0), counts, profile)


def is_junk_line(c: Column, score: Column) -> Column:
    """Blank, unsure, almost without letters and digits, broken into short capitals, or long without meaningful words."""

    def judged(x: Column) -> Column:
        s, tokens = x["s"], x["tokens"]
        n = F.size(tokens)
        short = F.size(F.filter(tokens, lambda t: F.length(t) <= 2)) / n
        capital = F.size(F.filter(tokens, lambda t: (F.length(t) <= 3) & (t == F.upper(t)) & (t != F.lower(t)))) / n
        meaning = F.size(F.filter(tokens, lambda t: (F.length(t) >= 4) | t.rlike(LOWER_ACCENT_CLASS)))
        few = F.aggregate(tokens, F.lit(0), lambda a, t: a + F.length(t)) < 2  # tokens are the runs of letters and digits
        return (s == "") | few | ((n >= 6) & (short >= 0.45) & (capital >= 0.40)) | ((n >= 8) & (meaning <= 2))

    with_tokens = bound(trimmed(c), lambda s: F.struct(s.alias("s"), F.regexp_extract_all(s, F.lit(f"([{LINE_LETTERS}0-9]+)"), 1).alias("tokens")))
    return F.coalesce(score < 0.45, F.lit(False)) | bound(with_tokens, judged)


def number(c: Column) -> Column:
    """A finite double, else 0."""
    d = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)
