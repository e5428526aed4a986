"""Functions on names of persons: folding, keys, honorifics, confidence of aliases, roles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACE, collapse, trimmed

# Honorific suffixes in the order in which they are tried.
HONORIFICS = (
    "điện hạ", "thái hậu", "đế vương", "quốc vương", "tướng quân", "tiên tử", "công chúa", "hoàng tử", "thái tử", "đại sư", "tiên sinh", "đại nhân", "lão sư", "tiền bối",
    "sư huynh", "sư tỷ", "sư phụ", "sư đệ", "sư muội", "đạo trưởng",
)
# Labels of relationships and what each stands for.
RELATIONSHIPS = {
    "mẹ": "mother", "me": "mother", "mother": "mother", "mẹ nuôi": "mother",
    "cha": "father", "bố": "father", "father": "father", "dad": "father",
    "anh trai": "older_brother", "anh": "older_brother", "older brother": "older_brother",
    "chị gái": "older_sister", "chị": "older_sister", "older sister": "older_sister",
    "em trai": "younger_brother", "em": "younger_brother", "younger brother": "younger_brother",
    "em gái": "younger_sister", "younger sister": "younger_sister",
    "chị em": "sibling", "anh em": "sibling", "sibling": "sibling", "siblings": "sibling",
    "con trai": "son", "son": "son", "con gái": "daughter", "daughter": "daughter",
    "con": "child", "child": "child", "children": "child",
    "vợ": "wife", "wife": "wife", "người vợ": "wife", "chồng": "husband", "husband": "husband", "người chồng": "husband",
    "người yêu": "lover", "lover": "lover", "bạn gái": "lover",
    "bạn thân": "friend", "bạn": "friend", "friend": "friend", "thù": "enemy", "kẻ thù": "enemy", "enemy": "enemy",
    "thầy": "mentor", "sư phụ": "mentor", "mentor": "mentor", "đối thủ": "rival", "rival": "rival", "đồng nghiệp": "colleague", "colleague": "colleague",
}
# Base confidence of an alias by how it was found; bonus per cited line and its limit; decay per alias beyond.
ALIAS_BASE = {"exact": 0.95, "normalized": 0.95, "substring": 0.85, "levenshtein": 0.75, "llm": 0.6}
LINE_BONUS, MOST_BONUS, CROWD, CROWD_DECAY = 0.05, 0.2, 3, 0.85
HIGH, MEDIUM = 0.8, 0.6


def _fold_table() -> tuple[str, str]:
    """Composed Latin letters and their base letters, from the Unicode data."""
    a, b = [], []
    for o in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(o)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(o):
            a.append(chr(o))
            b.append(base)
    return "".join(a) + "đĐ", "".join(b) + "dD"


_FROM, _TO = _fold_table()


def fold_sql(x: str) -> str:
    """``fold`` as SQL, by the same table."""
    return f"regexp_replace(translate({x}, '{_FROM}', '{_TO}'), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"


def canonical_sql(x: str) -> str:
    """``canonical`` as SQL."""
    return f"trim(regexp_replace(regexp_replace(lower({fold_sql(x)}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def fold(text: Column) -> Column:
    """Latin letters without accents, đ as d; combining marks are dropped."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), "[\\u0300-\\u036f]", "")


def canonical(name: Column) -> Column:
    """Folded, lower case, anything but ASCII letters, digits and _ as a space."""
    return collapse(F.regexp_replace(F.lower(fold(name)), "[^a-z0-9_\\s]", " "))


def key(name: Column) -> Column:
    """Lower case with collapsed white space; accents stay."""
    return F.lower(collapse(name))


def loose(name: Column) -> Column:
    """The canonical name without spaces; null if under two signs."""
    joined = F.regexp_replace(canonical(name), "[\\s\\-]+", "")
    return F.when(F.length(joined) >= 2, joined)


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared share of the words of two canonical names; 0 where neither has any."""
    x, y = (F.array_distinct(F.filter(F.split(canonical(c), " "), lambda w: w != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def without_honorific(name: Column) -> Column:
    """The key without the first suffix of the list that it ends with, if a base of two signs is left; else null."""
    k = key(name)
    out = F.lit(None).cast("string")
    for h in reversed(HONORIFICS):
        base = F.left(k, F.length(k) - len(h) - 1)
        out = F.when(F.endswith(k, F.lit(" " + h)) & (F.length(k) - len(h) >= 3), base).otherwise(out)
    return out


def relationship(label: Column) -> Column:
    """The canonical label, or the trimmed input where none is known."""
    known = F.create_map(*[F.lit(x) for pair in RELATIONSHIPS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key(label)), F.trim(label))


def alias_confidence(name: Column, alias: Column, method: Column, aliases: Column, lines: Column) -> Column:
    """Confidence of an alias between 0 and 1, to two decimals; 1 for the name itself, 0 for an empty one."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIAS_BASE.items() for x in kv]), method), F.lit(0.5))
    bonus = F.least(F.lit(MOST_BONUS), F.greatest(lines, F.lit(0)) * LINE_BONUS)
    decay = F.when(aliases > CROWD, F.pow(F.lit(CROWD_DECAY), aliases - CROWD)).otherwise(1.0)
    empty = (F.coalesce(name, F.lit("")) == "") | (F.coalesce(alias, F.lit("")) == "")
    same = F.lower(F.trim(name)) == F.lower(F.trim(alias))
    return F.when(empty, 0.0).when(same, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (base + bonus) * decay)), 2))


def alias_tier(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def fold_method(name: Column, alias: Column) -> Column:
    """How an alias relates to the name."""
    a, b = F.lower(F.trim(name)), F.lower(F.trim(alias))
    near = (F.length(a) <= 8) & (F.length(b) <= 8) & (F.levenshtein(a, b) <= 2)
    return (
        F.when(a == b, "exact").when(canonical(name) == canonical(alias), "normalized")
        .when(F.startswith(a, b) | F.endswith(a, b) | F.startswith(b, a) | F.endswith(b, a), "substring").when(near, "levenshtein").otherwise("llm")
    )


def role_by_aliases(role: Column, aliases: Column) -> Column:
    """A given role, else one by the number of aliases."""
    n = F.coalesce(F.size(aliases), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return F.when(role.isin("main", "supporting", "minor", "crowd"), role).when(n >= 3, "main").when(n <= 0, "minor").otherwise("supporting")


def proper_names(text: Column) -> Column:
    """Sequences of two to six capitalised words."""
    return F.regexp_extract_all(text, F.lit("(?:^|[^\\p{L}\\p{N}_])(\\p{Lu}\\p{L}*(?:\\s+\\p{Lu}\\p{L}*){1,5})(?=\\s|[,.:;!?…]|$)"), F.lit(1))


# What no name begins with, holds or ends with, and names of countries and titles that are none.
NAME_BOUNDS, WORD_BOUNDS = (4, 40), (2, 5)
COUNTRIES = (
    "Nhật Bản", "Trung Quốc", "Việt Nam", "Hàn Quốc", "Mỹ", "Anh", "Pháp", "Đức", "Nga", "Thái Lan", "Singapore", "Úc", "Canada", "Đài Loan", "Hồng Kông", "Quảng Đông",
    "Bắc Kinh", "Thượng Hải",
)
TITLES_ALONE = (
    "Thái Hậu", "Hoàng Hậu", "Thái Tử", "Hoàng Thượng", "Quốc Vương", "Hoàng Tử", "Đại Vương", "Tiên Tử", "Thiên Hạ", "Ông Nội", "Bà Nội", "Ông Ngoại", "Bà Ngoại", "Mẹ Chồng",
    "Mẹ Vợ", "Bố Chồng", "Bố Vợ",
)


def valid_name(name: Column, stop: tuple[str, ...] = ("nhưng", "hắn", "nàng", "the", "and")) -> Column:
    """4 to 40 signs, two to five words, each capitalised and none a stop word."""
    words = F.split(collapse(name), " ")
    return F.length(name).between(*NAME_BOUNDS) & F.size(words).between(*WORD_BOUNDS) & F.forall(words, lambda w: w.rlike("^\\p{Lu}") & ~F.lower(w).isin(*stop))


def vietnamese_name(name: Column, stop: tuple[str, ...] = ("nhưng", "hắn", "nàng", "the", "and"), honorific: tuple[str, ...] = (), endings: tuple[str, ...] = ()) -> Column:
    """Whether a text may be the name of a person in a Vietnamese book: 4 to 40 signs, two to five words, each with a capital, none a stop word or
    an honorific, no rejected ending at its end; words of plain Latin letters count only beside one with accents, and no
    country or bare title does."""
    words = F.split(collapse(name), " ")
    accented = lambda w: w.rlike("[\\u00C0-\\u1EF9]")
    plain = lambda w: w.rlike("^[A-Za-z]+$")
    some = F.exists(words, accented)
    fits = lambda w: accented(w) | w.rlike("^\\p{Lu}$") | (F.length(w).between(2, 8) & (~plain(w) | some))
    last = F.lower(F.element_at(words, -1))
    refused = [F.endswith(last, F.lit(e)) for e in endings]
    shape = F.length(name).between(*NAME_BOUNDS) & F.size(words).between(*WORD_BOUNDS)
    good = F.forall(words, lambda w: w.rlike("^\\p{Lu}") & ~F.lower(w).isin(*stop, *honorific) & fits(w))
    out = shape & good & ~collapse(name).isin(*COUNTRIES, *TITLES_ALONE)
    for r in refused:
        out = out & ~r
    return out


# Verbs that end the name at the beginning of an evidence, words that no such name begins with, words that alone are none.
EVIDENCE_VERBS = "là|mặc|thấy|có|đứng|ngồi|nói|hỏi|cầm|mang|bước|vung|cảm"
EVIDENCE_STARTS = (
    "Trong", "Ngoài", "Một", "Hai", "Ba", "Bốn", "Năm", "Sáu", "Bảy", "Tám", "Chín", "Mười", "Đây", "Đó", "Kia", "Trên", "Dưới", "Trước", "Sau", "Ngang", "Dọc", "Anh", "Chị",
    "Em", "Ông", "Bà", "Cô", "Chú", "Bác", "Cậu", "Mày", "Ta", "Tôi", "Hắn", "Nó", "Họ", "Chúng", "Chàng", "Nàng", "Người", "Kẻ", "Bọn", "Đám", "Lão", "Phía", "Phương", "Nơi",
)
EVIDENCE_ALONE = "và|hoặc|nhưng|rồi|thì|mà|của|trong|ngoài"


def name_from_evidence(evidence: Column) -> Column:
    """The name that an evidence begins with, before its first verb; of 'a member of X' that X; null where none is sure."""
    raw = F.regexp_extract(evidence, f"(?iu)^\\s*[\"'“”]*\\s*([A-ZÀ-Ú][^,.;:()\\n]+?)\\s*(?:{EVIDENCE_VERBS})", 1)
    name = F.regexp_replace(trimmed(raw), "^[\"'“”]+|[\"'“”]+$", "")
    member = "(?iu)^người\\s+của\\s+"
    usual = (F.length(name) >= 2) & ~F.substring_index(collapse(name), " ", 1).isin(*EVIDENCE_STARTS) & ~name.rlike(f"(?iu)^(?:{EVIDENCE_ALONE})$")
    return F.when(name.rlike(member), trimmed(F.regexp_replace(name, member, ""))).when(usual, name)


# Titles in names, in order of precedence, with the gender, age and role they stand for.
TITLE_MARKERS = (
    ("Cửu\\s+Thiên\\s+Huyền\\s+Nữ", "female", "mature", "main"),
    ("Huyền\\s+Nữ", "female", "mature", "main"),
    ("Thiếu\\s+Nữ", "female", "young", "supporting"),
    ("Tiên\\s+Nữ", "female", "mature", "supporting"),
    ("Yêu\\s+Nữ", "female", "mature", "supporting"),
    ("Ma\\s+Nữ", "female", "mature", "supporting"),
    ("Công\\s+Chúa", "female", "young", "main"),
    ("Hoàng\\s+Hậu", "female", "mature", "main"),
    ("Thái\\s+Hậu", "female", "old", "main"),
    ("Phu\\s+Nhân", "female", "mature", "supporting"),
    ("Nương\\s+Tử", "female", "young", "supporting"),
    ("Tiểu\\s+Thư", "female", "young", "supporting"),
    ("Đại\\s+Tiểu\\s+Thư", "female", "young", "supporting"),
    ("Hoàng\\s+Thượng", "male", "mature", "main"),
    ("Quốc\\s+Vương", "male", "mature", "main"),
    ("Thánh\\s+Vương", "male", "mature", "main"),
    ("(?:Phù\\s+Quang|Vạn\\s+Phật|Tiên\\s+|Thiên\\s+)\\s*Vương", "male", "mature", "main"),
    ("Vương", "male", "mature", "main"),
    ("Hoàng\\s+Tử", "male", "young", "main"),
    ("Thái\\s+Tử", "male", "young", "main"),
    ("Thiên\\s+Đế", "male", "mature", "main"),
    ("(?:Đại\\s+|Ma\\s+|Tông\\s+)?Đế", "male", "mature", "main"),
    ("Tông\\s+Chủ", "male", "mature", "main"),
    ("Ma\\s+Tôn", "male", "mature", "main"),
    ("Thánh", "male", "mature", "main"),
    ("Thiếu\\s+Gia", "male", "young", "supporting"),
    ("Lão\\s+Gia", "male", "old", "supporting"),
    ("Lão", "male", "old", "supporting"),
    ("Trưởng\\s+Lão", "male", "old", "supporting"),
    ("Thiếu\\s+Niên", "male", "young", "supporting"),
    ("Đại\\s+Sư", "male", "old", "supporting"),
)
# Words near a name that show its gender and its tone, the first that fits counts.
GENDER_CUES = (("female", "nữ|cô|chị|tỷ|ma\\s+nữ|nương\\s+tử|tiểu\\s+thư|phu\\s+nhân"), ("male", "nam|chú|anh|huynh|thiếu\\s+gia|tông\\s+chủ|ma\\s+tôn|hoàng\\s+thượng|lão\\s+gia"))
TONE_CUES = (("cheerful", "hài hước|vui|cười|tươi"), ("cold", "lạnh lùng|lạnh|tàn nhẫn|ác"), ("angry", "nóng nảy|phẫn nộ|giận"), ("mysterious", "bí ẩn|thần bí|trầm"))
_EDGE, _EDGE_END = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"


def title_markers(name: Column) -> Column:
    """(gender, age, role) by the first title of the list that stands in the name as words."""
    of = lambda g, a, r: F.struct(F.lit(g).alias("gender"), F.lit(a).alias("age"), F.lit(r).alias("role"))
    out = of("unknown", "unknown", "supporting")
    for words, *found in reversed(TITLE_MARKERS):
        out = F.when(name.rlike(f"{_EDGE}(?:{words}){_EDGE_END}"), of(*found)).otherwise(out)
    return out


def prose_cues(sentence: Column, name: Column) -> Column:
    """(gender, tone) by the words from 80 signs before the name to 200 behind it; 'unknown' where nothing tells."""
    at = F.instr(sentence, name)
    first = F.greatest(at - 80, F.lit(1))
    near = F.lower(F.substring(sentence, first, at + F.length(name) + 200 - first))
    gender, tone = F.lit("unknown"), F.lit("unknown")
    for value, words in reversed(GENDER_CUES):
        gender = F.when(near.rlike(f"{_EDGE}(?:{words}){_EDGE_END}"), value).otherwise(gender)
    for value, words in reversed(TONE_CUES):
        tone = F.when(near.rlike(words), value).otherwise(tone)
    return F.when(at > 0, F.struct(gender.alias("gender"), tone.alias("tone")))


__all__ = [n for n in dir() if not n.startswith("_")] + ["SPACE"]
