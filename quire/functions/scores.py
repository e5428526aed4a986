"""Keyword classifiers, stable hashes and scores."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords by emotion in order of precedence, with what each does to speed and expressiveness.
EMOTIONS = (
    ("excited", 1.22, 0.26, "kiếm|đao|thương|chiến|tấn công|bùng nổ|cuộn trào|huyết mạch|linh lực|chân khí|đánh|giết|chém|đâm|phá cảnh|huyết chiến|giao chiến|công kích|đại chiến|hủy diệt"),
    ("angry", 1.18, 0.22, "phản bội|căm hận|thù hận|tức giận|giận dữ|phẫn nộ|không tha thứ|kẻ thù|nghịch nhân|hét lên|gầm lên|thét"),
    ("sad", 0.80, -0.25, "nước mắt|khóc|rơi lệ|sầu|buồn|thất vọng|đau lòng|mất đi|ra đi|không trở về|vĩnh biệt|cô đơn|cô quạnh|tiếc nuối|hối hận"),
    ("romantic", 0.88, -0.12, "tim đập|yêu nhau|ngại ngùng|e thẹn|má đỏ|ôm lấy|vòng tay|ánh mắt ấm|nhìn nhau|yêu thương|đôi ta|nắm tay|hôn|hôn nhau|trao nhau|nụ hôn"),
    ("tense", 1.07, 0.10, "nguy hiểm|căng thẳng|hồi hộp|bóng tối|im lặng đột|tiến lại|vây quanh|rùng mình|phục kích|kẻ địch xuất"),
    ("calm", 0.90, -0.18, "yên tĩnh|bình yên|thanh thản|nhẹ nhàng|thư thái|gió thổi nhẹ|ánh trăng|bình thản|thong thả|an bình"),
)
# The least score of an attribution by genre, and its default.
LEAST_SCORE = {
    "tu_tieu_thuyet": 0.48, "kiếm_hiệp": 0.48, "huyền_huyễn": 0.48, "cổ_trang": 0.46, "lich_su": 0.46, "ngon_tinh": 0.38, "do_thi": 0.4,
    "game_system": 0.4, "kinh_di": 0.36, "khoa_hoc_vien_tuong": 0.4, "thieu_nien": 0.38,
    "tu_tien": 0.48, "tu_tiên": 0.48, "co_trang": 0.46, "co_trạng": 0.46, "ngôn_tình": 0.38, "đô_thị": 0.4, "lịch_sử": 0.46,
}
LEAST_SCORE_DEFAULT = 0.42


def _last_place(text: Column, words: str) -> Column:
    """Place (from 0) of the last occurrence of a word that no letter touches, or -1."""
    head = F.regexp_extract(text, f"(?s)^(.*(?<![\\p{{L}}\\p{{M}}]))(?:{words})(?![\\p{{L}}\\p{{M}}])", 1)
    return F.when(text.rlike(f"(?<![\\p{{L}}\\p{{M}}])(?:{words})(?![\\p{{L}}\\p{{M}}])"), F.length(head)).otherwise(-1)


def emotion(text: Column, speed: Column, noise: Column, intensity: Column, table: Sequence[tuple] = EMOTIONS) -> Column:
    """(emotion, speed, noise_scale): the keyword that comes last decides, earlier entries win ties.

    Anger gives way to any other keyword; three exclamation marks without any keyword are anger too. Both values move
    from their base by ``intensity`` and stay within bounds.
    """
    t = F.lower(text)
    loud = F.when(F.regexp_count(text, F.lit("!")) >= 3, F.length(text) - F.locate("!", F.reverse(text))).otherwise(-1)
    places = {name: _last_place(t, words) for name, _, _, words in table}
    others = F.greatest(*[p for name, p in places.items() if name != "angry"])
    places["angry"] = F.when(others >= 0, -1).otherwise(F.greatest(places["angry"], loud))
    best = F.greatest(*places.values())
    out = lambda name, s, n: F.struct(F.lit(name).alias("emotion"), s.alias("speed"), n.alias("noise_scale"))
    clamp = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    picked = out("neutral", clamp(speed, 0.5, 2.5), clamp(noise, 0.25, 0.95))
    for name, times, plus, _ in reversed(table):
        s, n = clamp(speed * times, 0.5, 2.5), clamp(noise + plus, 0.25, 0.95)
        this = out(name, clamp(speed + (s - speed) * intensity, 0.5, 2.5), clamp(noise + (n - noise) * intensity, 0.25, 0.95))
        picked = F.when((best >= 0) & (places[name] == best), this).otherwise(picked)
    return picked


def least_score(genre: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LEAST_SCORE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(genre))), F.lit(LEAST_SCORE_DEFAULT))


# What readers and shops call the genres.
GENRE_HINTS = {
    "tu tiên": "tu_tieu_thuyet", "tu tien": "tu_tieu_thuyet", "kiếm hiệp": "tu_tieu_thuyet", "kiem hiep": "tu_tieu_thuyet", "huyền huyễn": "tu_tieu_thuyet",
    "huyen huyen": "tu_tieu_thuyet", "tiên hiệp": "tu_tieu_thuyet", "tien hiep": "tu_tieu_thuyet", "cultivation": "tu_tieu_thuyet", "wuxia": "tu_tieu_thuyet",
    "xianxia": "tu_tieu_thuyet", "ngôn tình": "ngon_tinh", "ngon tinh": "ngon_tinh", "romance": "ngon_tinh", "ngọt": "ngon_tinh", "lịch sử": "lich_su", "lich su": "lich_su",
    "cổ trang": "lich_su", "co trang": "lich_su", "cung đấu": "lich_su", "cung dau": "lich_su", "historical": "lich_su", "costume drama": "lich_su", "đô thị": "do_thi",
    "do thi": "do_thi", "urban": "do_thi", "modern": "do_thi", "hệ thống": "game_system", "he thong": "game_system", "game": "game_system", "litrpg": "game_system",
    "kinh dị": "kinh_di", "kinh di": "kinh_di", "horror": "kinh_di", "khoa học viễn tưởng": "khoa_hoc_vien_tuong", "sci-fi": "khoa_hoc_vien_tuong",
    "scifi": "khoa_hoc_vien_tuong", "thanh xuân": "thieu_nien", "thanh xuan": "thieu_nien", "học đường": "thieu_nien", "hoc duong": "thieu_nien", "youth": "thieu_nien",
}


def genre_hint(hint: Column) -> Column:
    """The genre that a hint names, by its own name or by what it is called; null for anything else."""
    h = F.lower(F.trim(hint))
    known = F.create_map(*[F.lit(x) for kv in (GENRE_HINTS | {g: g for g in set(GENRE_HINTS.values())}).items() for x in kv])
    return F.try_element_at(known, h)


# Sounds that a text may ask for, in order, with the words that ask for them; sounds by a model's word and by a voice's tone.
SOUNDS = (
    ("[cười]", "(?iu)(?<![\\p{L}\\p{N}_])(?:haha|ha ha|hehe|hihi|hê hê|cười lớn|phá lên cười|cười khanh khách|cười khúc khích|cười ha hả|cười hô hố|cười rúc rích|cười gằn|哈哈)(?![\\p{L}\\p{N}_])"
     "|khanh khách|khúc khích|hô hố|ha hả|khẽ cười|nhếch mép cười|cười gượng|\\(\\s*(?:cười gằn|cười khổ)\\s*\\)"),
    ("[thở dài]", "(?iu)(?<![\\p{L}\\p{N}_])(?:thở dài|thở một tiếng|thở dốc|thở phào|than thở|thở hắt ra|哀)(?![\\p{L}\\p{N}_])"
     "|thở dài|thở dốc|thở ra một hơi|thở phào|tiếng thở dài|\\(\\s*(?:thở dài|thở một tiếng|than thở|thở phào)\\s*\\)"),
    ("[hắng giọng]", "(?iu)(?<![\\p{L}\\p{N}_])(?:hắng giọng|hắng hắng|hắng một tiếng|khụt khịt|nghẹn lại|nghẹn ngào|sniff)(?![\\p{L}\\p{N}_])"
     "|hắng giọng|khóc thét|khóc nức nở|khóc sụt sịt|sụt sịt|sniff sniff"),
)
TOLD_SOUNDS = {
    "cheerful": "[cười]", "happy": "[cười]", "joy": "[cười]", "laugh": "[cười]", "amused": "[cười]", "sad": "[thở dài]", "sorrow": "[thở dài]", "sigh": "[thở dài]",
    "regret": "[thở dài]", "angry": "[hắng giọng]", "rage": "[hắng giọng]", "furious": "[hắng giọng]", "shout": "[hắng giọng]", "sneer": "[hắng giọng]",
}
TONE_SOUNDS = {"angry": "[hắng giọng]", "sad": "[thở dài]"}


def with_sounds(text: Column, kind: Column, tone: Column, told: Column) -> Column:
    """A segment with the sounds it asks for: those of its own words behind it, then a model's word and, in dialogue, the
    voice's tone before it; a segment that begins with a bracket gets neither. Other short tokens in brackets go."""
    of = lambda table, word: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)
    bare = F.regexp_replace(text, "\\s*\\[(?:cười|thở dài|hắng giọng)\\]\\s*", " ")
    out = text
    for sound, words in SOUNDS:
        out = F.when(bare.rlike(words), F.concat(out, F.lit(f" {sound} "))).otherwise(out)
    begun = F.startswith(F.ltrim(out), F.lit("["))
    model, voice = of(TOLD_SOUNDS, told), F.when(kind == "dialogue", of(TONE_SOUNDS, tone))
    first = F.when(begun, out).when(model.isNotNull(), F.trim(F.concat(model, F.lit(" "), out))).when(voice.isNotNull(), F.trim(F.concat(voice, F.lit(" "), out))).otherwise(out)
    swept = F.regexp_replace(first, "\\[(?!(?:cười|thở dài|hắng giọng)\\])[^\\[\\]\\r\\n]{1,16}\\]", "")
    return F.when(F.contains(first, F.lit("[")), F.trim(F.regexp_replace(swept, "[ \\t]{2,}", " "))).otherwise(first)


def safe_count(value: Column, most: int = 1_000_000) -> Column:
    """A whole number from 0 to ``most`` out of noisy text; 0 for what is none."""
    n = value.try_cast("double")
    whole = F.when(n.isNull() | F.isnan(n) | (F.abs(n) > 1e18), 0).otherwise(n.cast("long"))
    return F.greatest(F.lit(0), F.least(F.lit(most), whole)).cast("int")


def _object_in(raw: str | None) -> str:
    text = re.sub(r"\n?```\s*\Z", "", re.sub(r"\A```(?:json)?\s*\n?", "", (raw or "").strip()))
    reader = json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer("{", text))]:
        try:
            found, end = reader.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(found, dict) and (at or end == len(text) or text[at] == "{"):
            return json.dumps(found, ensure_ascii=False, sort_keys=True)
    return "{}"


def json_anywhere(text: Column) -> Column:
    """The first JSON object in a text, fences or words around it or not, with sorted keys; '{}' where there is none."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(_object_in)

    return run(text)


def genre_scores(docs: DataFrame, text: str, key: str, keywords: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """(key, genre, score, confidence): strong words count 3, words 2, hints 0.5; 'unknown' under a score of 1.

    The keyword table is a parameter of fixed size, so it becomes expressions; no join is needed.
    """
    weights = {"strong": 3.0, "words": 2.0, "bonus": 0.5}
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    scores = []
    for genre, lists in sorted(keywords.items()):
        total = F.lit(0.0)
        for kind, words in lists.items():
            if words:
                total = total + F.regexp_count(t, F.lit("|".join(f"\\Q{w}\\E" for w in words))) * weights[kind]
        scores.append(F.struct(F.when(F.length(t) < 30, total * 0.6).otherwise(total).alias("score"), F.lit(genre).alias("genre")))
    # the explode keeps the optimizer from computing the scores anew in each column made of them
    d = docs.select(key, F.explode(F.array(F.sort_array(F.array(*scores), asc=False))).alias("r"))
    d = d.withColumn("all", F.aggregate("r", F.lit(0.0), lambda a, x: a + x["score"]))
    first, second = F.col("r")[0], (F.col("r")[1]["score"] if len(scores) > 1 else F.lit(0.0))
    sure = first["score"] >= 1
    share = F.when(F.col("all") > 0, first["score"] / F.col("all")).otherwise(0.0)
    margin = F.when(first["score"] > 0, (first["score"] - second) / first["score"]).otherwise(0.0)
    return d.select(
        key, F.when(sure, first["genre"]).otherwise("unknown").alias("genre"), first["score"].alias("score"), F.when(sure, F.round(0.5 * share + 0.5 * margin, 4)).otherwise(0.0).alias("confidence")
    )


def _hash(text: Column, start: int, times: int) -> Column:
    """A 32-bit signed hash over code points."""
    wrap = lambda v: F.pmod(v + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(points, F.lit(start).cast("bigint"), lambda h, c: wrap(h * times + c))


def slot(text: Column, size: int) -> Column:
    """A stable slot from 0 to size - 1 by a times-31 hash."""
    return F.pmod(F.abs(_hash(text, 0, 31)), F.lit(size)).cast("int")


def variant(text: Column, size: int) -> Column:
    """A stable variant by a times-33 hash, taken as unsigned."""
    return F.pmod(F.pmod(_hash(text, 5381, 33), F.lit(1 << 32)), F.lit(size)).cast("int")


def voice_score(voice_gender: Column, voice_age: Column, voice_tone: Column, gender: Column, age: Column, tone: Column) -> Column:
    """How well a voice fits: its gender counts 10 or against it 20, age 3, tone 5."""
    g, a, t = (F.lower(c) for c in (gender, age, tone))
    return (
        F.when(g.isin("male", "female"), F.when(voice_gender == g, 10).otherwise(-20)).otherwise(0)
        + F.when(a.isin("young", "mature", "old") & (voice_age == a), 3).otherwise(0)
        + F.when((t != "unknown") & (voice_tone == t), 5).otherwise(0)
    )


def config_hash(columns: Sequence[str]) -> Column:
    """A digest of settings that doesn't depend on their order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def validation_score(errors: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 20 * errors - 5 * warnings)


def smoothed(values: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average over an ordered array; null for an empty one."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda acc, v: F.when(acc.isNull(), v).otherwise(acc * (1 - alpha) + v * alpha))
