"""Problem 4: variant spellings of names.

Every name becomes a form; forms of one book that share enough q-grams are found by a prefix-filtered set-similarity
join, rarest q-grams first, and verified by a soft token similarity in which rare tokens count more: a token weighs the
logarithm of its rarity, what finds no partner counts against the link by its weight, and whether two tokens that
differ by a slip are one depends on how rare the one is beside the other. Certain links are joined into groups; a form
that is less than a full name (initials, a title with one name, a part of a name, another script or one without
accents, a doubtful slip) joins a group only if it fits no other group of its book. The same holds for aliases that
are less than a full name, unless so large a share of all groups has the alias that it is generic. Forms of address
and short names for given names are learned from the names themselves.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.lookalikes import _counts, _dominant, _substituted, normal
from quire.session import cut, shuffled

#: q-grams and the Jaccard similarity of their sets that candidates must reach.
Q, SHARED = 3, 0.35
#: Soft token similarity that a link needs; that of two tokens that differ by one slip, of an initial, abbreviation or nickname.
LINK, SLIP, INITIAL = 0.8, 0.9, 0.85
#: What a part must have of the weight of the whole name.
PART = 0.3
#: Two tokens that differ by a slip are names of their own if the rarer occurs so often, and so often beside the other.
USUAL, SLIP_SHARE = 3, 0.1
#: An alias is generic if at least USUAL groups and so large a share of all of them have it.
GENERIC_SHARE = 0.001
#: A beginning is a form of address if in so many names, and so large a share of all, what follows it is a name of that book.
ADDRESSES, ADDRESS_SHARE = 5, 0.5
#: Books in which a record must have two names that differ in the same two tokens for these to be taken as a nickname.
NICKNAMES = 3
#: What the driver may hold of each kind of learned items; more is an error, never cut off.
MOST_LEARNED = 100_000
#: Rows of one (book, q-gram) that are compared within one task; more are split into parts, every two of which meet.
HOT = 2000
#: Hot q-grams that are broadcast at most.
FEW_HOT = 100_000
#: One cell of the component grid is enough here, since edges of names are few beside the names.
LEAST_BLOCKS = 1

# Forms of address, which are no part of a name.
_TITLES = frozenset(
    "mr mrs ms miss mister dr prof professor cpt capt captain dame lady lord sir madam old young lt sgt the"
    " ông bà cô thầy anh chị chú bác cụ lão cậu dì cái con".split()
)
_HAN_BEFORE, _HAN_AFTER = "老小阿", ("公子", "姑娘", "先生", "大人", "小姐", "夫人")
# Traditional signs over the simplified ones.
_TRADITIONAL = "蘇鶴溫遠陸嵐煙顧雲風張劉陳楊趙黃吳孫馬葉鄧許蕭馮鄭謝韓龍鳳蘭藍靈麗華國東長門問聞"
_SIMPLIFIED = "苏鹤温远陆岚烟顾云风张刘陈杨赵黄吴孙马叶邓许萧冯郑谢韩龙凤兰蓝灵丽华国东长门问闻"
# Readings of signs that names are made of.
_READINGS = dict(
    x.split(":")
    for x in (
        "江:jiang 苏:su 柳:liu 林:lin 金:jin 阮:ruan 沈:shen 雪:xue 墨:mo 溪:xi 霜:shuang 鹤:he 陆:lu 竹:zhu 桐:tong 岚:lan 舟:zhou 松:song"
        " 温:wen 秋:qiu 季:ji 夜:ye 风:feng 宋:song 月:yue 远:yuan 寒:han 玉:yu 白:bai 青:qing 顾:gu 云:yun 安:an 烟:yan 清:qing 石:shi"
        " 傅:fu 裴:pei 张:zhang 王:wang 李:li 刘:liu 陈:chen 杨:yang 赵:zhao 黄:huang 周:zhou 吴:wu 徐:xu 孙:sun 马:ma 朱:zhu 胡:hu 郭:guo"
        " 何:he 高:gao 罗:luo 郑:zheng 梁:liang 谢:xie 唐:tang 许:xu 韩:han 冯:feng 邓:deng 曹:cao 彭:peng 曾:zeng 萧:xiao 田:tian 董:dong"
        " 兰:lan 梅:mei 龙:long 凤:feng 华:hua 明:ming 平:ping 雨:yu 山:shan 海:hai 星:xing 天:tian 春:chun 冬:dong 夏:xia"
    ).split()
)
# The older place of the tone mark in open Vietnamese syllables, and the newer one.
_TONES = dict(x.split(":") for x in "oà:òa oá:óa oả:ỏa oã:õa oạ:ọa oè:òe oé:óe oẻ:ỏe oẽ:õe oẹ:ọe uỳ:ùy uý:úy uỷ:ủy uỹ:ũy uỵ:ụy".split())
_SIMPLE = str.maketrans(_TRADITIONAL, _SIMPLIFIED)
_HAN = regex.compile(r"\p{Han}")
_PARTS = regex.compile(r"[\p{L}\p{M}\p{N}]+\.?|\p{L}")


def fold(token: str) -> str:
    """Without accents, đ as d."""
    return "".join(c for c in unicodedata.normalize("NFD", token.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c))


def untyped(token: str) -> str:
    """What a Vietnamese syllable typed with doubled letters and tone letters stands for, without accents."""
    t = token.replace("dd", "d").replace("aa", "a").replace("oo", "o").replace("ee", "e")
    t = t.replace("w", "")
    return t[:-1] if len(t) > 2 and t[-1] in "sfrxj" else t


def _one_script(part: str, whole: dict[str, int]) -> str:
    """A token in one script: the one of the whole name, else its own dominant one, else any that leaves nothing of a second."""
    n = _counts(part)
    if not n or (len(n) == 1 and set(n) == {_dominant(whole, {})}):
        return part
    options = [_dominant(whole, {})] + ([_dominant(n, whole), *sorted(n)] if len(n) > 1 else [])
    made = [_substituted(part, s) for s in options]
    return next((m for m in made if len(_counts(m)) == 1), part)


def _unaddressed(tokens: list[str], learned: frozenset[str]) -> list[str]:
    """``tokens`` without the forms of address at their beginning."""
    k = 0
    while k < len(tokens):
        if " ".join(tokens[k : k + 2]) in learned and k + 2 < len(tokens):
            k += 2
        elif tokens[k].rstrip(".") in _TITLES or tokens[k].rstrip(".") in learned:
            k += 1
        else:
            break
    return tokens[k:]


def form_of(name: str | None, alias: bool = False, learned: frozenset[str] = frozenset()) -> tuple[str, bool] | None:
    """The canonical form of a name and whether it is less than a full name; None for nothing or a mere form of address.

    An alias in small letters ('the boy', 'boss') is no name. ``learned`` are forms of address besides the fixed ones.
    """
    if not name:
        return None
    text = normal(name).strip()
    if alias and text[:1].islower() and not any(c.isupper() for c in text):
        return None
    if _HAN.search(text):
        signs = "".join(c for c in text.translate(_SIMPLE) if _HAN.match(c))
        for tail in _HAN_AFTER:
            if signs.endswith(tail) and len(signs) - len(tail) >= 2:
                signs = signs[: -len(tail)]
                break
        if len(signs) > 3 - (signs[0] not in _READINGS) and signs[0] in _HAN_BEFORE:
            signs = signs[1:]
        return (signs, len(signs) < 2) if signs else None
    whole = _counts(text)
    plain: list[str] = []
    for part in text.replace("_", " ").split(","):
        tokens = [_one_script(t, whole).lower() for t in _PARTS.findall(part)]
        tokens = [t[:-2] + _TONES[t[-2:]] if t[-2:] in _TONES else t for t in tokens]
        plain += _unaddressed(tokens, learned)
    short = [t for t in plain if t.endswith(".") or len(t) == 1]
    if short == plain:
        return None
    return " ".join(plain), len(plain) == 1 or bool(short)


def _forms(learned: frozenset[str]):
    """(book_id, record, form, weak, alias): the forms of the name and of the aliases; alias marks a weak one that isn't the name's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for book, record, name, aliases in zip(*(b.column(c).to_pylist() for c in ("book_id", "record", "name", "aliases")), strict=True):
                own = form_of(name, learned=learned)
                found = [own] if own else []
                found += [f for f in (form_of(a, True, learned) for a in aliases or []) if f]
                for form, weak in dict.fromkeys(found):
                    for column, value in zip(out, (book, record, form, weak, weak and (form, weak) != own), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["book_id", "record", "form", "weak", "alias"])

    return run


def _held(df: DataFrame) -> list:
    rows = df.limit(MOST_LEARNED + 1).collect()
    if len(rows) > MOST_LEARNED:
        raise ValueError("more learned items than the driver may hold; raise MOST_LEARNED")
    return rows


def forms_of_address(records: DataFrame) -> frozenset[str]:
    """One or two words at the beginning of names after which, mostly, another name of the same book follows."""
    text = F.trim(F.regexp_replace(F.lower(F.col("text")), "\\s+", " "))
    d = records.select("book_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text"))
    d = d.select("book_id", text.alias("text")).where("instr(text, ' ') > 0").distinct()
    ways = [F.struct(F.substring_index("text", " ", k).alias("first"), F.expr(f"substring(text, length(substring_index(text, ' ', {k})) + 2)").alias("rest")) for k in (1, 2)]
    begun = d.select("book_id", "text", F.explode(F.array(*ways)).alias("w")).select("book_id", "w.first", "w.rest").where("instr(rest, ' ') > 0")
    known = d.select("book_id", F.col("text").alias("rest"), F.lit(1).alias("hit"))
    n = shuffled(begun, known, ["book_id", "rest"], "left").groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    n = n.where((F.col("hits") >= ADDRESSES) & (F.col("hits") >= ADDRESS_SHARE * F.col("n")))
    return frozenset(r["first"].rstrip(".") for r in _held(n.select("first")))


def nicknames(forms: DataFrame) -> frozenset[tuple[str, str]]:
    """Pairs of tokens that stand for each other in the names of one record, in NICKNAMES books at least."""
    d = forms.where("not weak and not alias").select("book_id", "record", "form", F.explode(F.split("form", " ")).alias("left_out"))
    d = d.withColumn("others", F.array_join(F.array_sort(F.array_remove(F.split("form", " "), F.col("left_out"))), " ")).where("others <> ''")
    near = d.groupBy("book_id", "record", "others").agg(F.min("left_out").alias("x"), F.max("left_out").alias("y"), F.count_distinct("left_out").alias("n")).where("n = 2")
    n = near.groupBy("x", "y").agg(F.count_distinct("book_id").alias("books")).where(F.col("books") >= NICKNAMES)
    return frozenset((r["x"], r["y"]) for r in _held(n.select("x", "y")))


def latin_tokens(form: str) -> list[str]:
    """The tokens by which a form is indexed: without accents, signs by their readings."""
    if _HAN.search(form):
        return [_READINGS.get(c, c) for c in form]
    return [fold(t).rstrip(".") for t in form.split()]


def variants(form: str) -> list[list[str]]:
    """The q-gram sets under which a form is indexed: as it is, and as typed Vietnamese where it may be that."""
    tokens = latin_tokens(form)
    ways = [tokens]
    if not _HAN.search(form) and form.isascii() and all(len(t) < 9 for t in tokens):
        typed = [untyped(t) for t in tokens]
        if typed != tokens:
            ways.append(typed)
    out = []
    for way in ways:
        found = set()
        for t in way:
            padded = f"#{t}#"
            found.update(padded[i : i + Q] for i in range(max(1, len(padded) - Q + 1)))
        out.append(sorted(found))
    return out


def _initial(token: str) -> bool:
    return token.endswith(".") or len(token) == 1


def slip_keys(token: str) -> set[str]:
    """What a token shares with every token that equals it but for one slip: itself and itself without one letter."""
    return {token} | ({token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) >= 3 else set())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(book_id, form, size, variant, keys, token): by variant -1 or above q-grams, below that the slips of a whole token.

    Variant -2 - i has those of the i-th whole token; ``token`` is that token. The joined tokens are one as well, with
    a null token. A form with initials may be of a name of as many tokens, so its size is less by one.
    """
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for book, form in zip(b.column("book_id").to_pylist(), b.column("form").to_pylist(), strict=True):
            rows: list[tuple] = [(v, g, None) for v, g in enumerate(variants(form))]
            size = 0
            if not _HAN.search(form):
                tokens = form.split()
                plain = [fold(t) for t in tokens if not _initial(t)]
                size = len(tokens) * 2 - (len(plain) < len(tokens))
                whole: list[tuple] = [(t, t) for t in plain] + ([("".join(plain), None)] if len(tokens) > 1 and len(plain) == len(tokens) else [])
                rows += [(-2 - i, sorted(slip_keys(t)), own) for i, (t, own) in enumerate(whole)]
            for variant, keys, token in rows:
                for column, value in zip(out, (book, form, size, variant, keys, token), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["book_id", "form", "size", "variant", "keys", "token"])


def slip(a: str, b: str) -> bool:
    """Whether one letter was left out, doubled, mistaken, or exchanged with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _similar(a: str, b: str, usual: dict[str, int], total: int = 0, nick: frozenset = frozenset()) -> tuple[float, str]:
    """How similar two tokens are, and which of them is the lesser one, 'a' or 'b', if the likeness is doubtful."""
    if a == b:
        return 1.0, ""
    lesser = "a" if (len(a), a) <= (len(b), b) else "b"
    short, long = (a, b) if lesser == "a" else (b, a)
    if _initial(short):
        return (INITIAL, lesser) if long.startswith(short.rstrip(".")) else (0.0, "")
    if _initial(long) and len(long) > 1:  # an abbreviation with its full stop
        return (INITIAL, "b" if lesser == "a" else "a") if short.startswith(long.rstrip(".")) else (0.0, "")
    if len(short) >= 2 and slip(a, b):
        low, high = sorted((usual.get(a, 0), usual.get(b, 0)))
        apart = low >= USUAL and low > SLIP_SHARE * high
        if len(short) >= 6 and a.isascii() and b.isascii():
            return SLIP, ""
        if not apart:
            rarer = "a" if (usual.get(a, 0), a) <= (usual.get(b, 0), b) else "b"
            return SLIP, "" if len(short) >= 4 else rarer
    if (min(a, b), max(a, b)) in nick:
        return INITIAL, lesser
    if len(short) >= 2 and len(long) >= len(short) + 2 and long.startswith(short) and usual.get(long, 0) ** 2 >= total > 0:
        return INITIAL, lesser  # an abbreviation of a word that many names have
    return 0.0, ""


def soft_similarity(a: list[str], b: list[str], weight, usual: dict[str, int], total: int = 0, nick: frozenset = frozenset()) -> tuple[float, list[str], list[str], set[str]]:
    """Weighted share of what two token lists have in common, the tokens of each that found no partner,
    and the lesser sides of the tokens that did: empty for a certain one, else "a" or "b"."""
    left_a, left_b = list(a), list(b)
    common = whole = 0.0
    doubts: set[str] = set()
    for x in a:
        if x in left_b:
            if not _initial(x):
                doubts.add("")  # at least one token that is certain
            left_a.remove(x)
            left_b.remove(x)
            common += weight(x)
            whole += weight(x)
    if left_a and left_b:
        found = [(s, i, j, who) for i, x in enumerate(left_a) for j, y in enumerate(left_b) for s, who in [_similar(x, y, usual, total, nick)] if s]
        used_a: set[int] = set()
        used_b: set[int] = set()
        for s, i, j, who in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                w = max(weight(left_a[i]), weight(left_b[j])) if not who else min(weight(left_a[i]), weight(left_b[j]))
                common += s * w
                whole += w
                doubts.add(who)
        left_a = [x for i, x in enumerate(left_a) if i not in used_a]
        left_b = [x for j, x in enumerate(left_b) if j not in used_b]
    whole += sum(map(weight, left_a)) + sum(map(weight, left_b))
    return (common / whole if whole else 0.0), left_a, left_b, doubts


def _readings_of(form: str) -> set[str]:
    """The joined readings of a name in Latin script with the family name first, whichever end it stands at."""
    t = [fold(x) for x in form.split()]
    return {"".join(t), "".join(t[1:] + t[:1]), "".join(t[-1:] + t[:-1])}


def verify(a: str, b: str, weight, usual: dict[str, int], total: int = 0, nick: frozenset = frozenset()) -> str:
    """How two forms are linked: 'same', 'a' or 'b' (that one is less than the other), 'a?' or 'b?' (not, but it may be meant), or ''.

    ``weight`` gives the weight of a token, ``usual`` the names that have it, ``total`` how many names there are.
    """
    han_a, han_b = bool(_HAN.search(a)), bool(_HAN.search(b))
    if han_a and han_b:
        for own, other, who in ((a, b, "a"), (b, a, "b")):
            if 2 <= len(own) < len(other) <= 2 * len(own) and other.endswith(own):
                return who  # a given name without the family name
        return ""
    if han_a or han_b:
        signs, latin = (a, b) if han_a else (b, a)
        read = "".join(_READINGS.get(c, c) for c in signs)
        return ("b" if han_a else "a") if len(signs) > 1 and read in _readings_of(latin) else ""
    ta, tb = a.split(), b.split()
    initials = any(map(_initial, ta + tb))
    joined_a, joined_b = "".join(ta), "".join(tb)
    if min(len(joined_a), len(joined_b)) >= 6 and (joined_a == joined_b or (len(ta) != len(tb) and not initials and slip(joined_a, joined_b))):
        return "same"
    score, rest_a, rest_b, doubts = soft_similarity(ta, tb, weight, usual, total, nick)
    if not rest_a and not rest_b and score >= LINK and "" in doubts:
        return min(doubts - {""}, default="same")
    if a.isascii() != b.isascii():
        plain_a, plain_b = [fold(t) for t in ta], [fold(t) for t in tb]
        typed = [untyped(t) for t in (plain_a if a.isascii() else plain_b)]
        other = sorted(plain_b if a.isascii() else plain_a)
        if other in (sorted(plain_a if a.isascii() else plain_b), sorted(typed)):
            return "a" if a.isascii() else "b"
    if bool(rest_a) != bool(rest_b):
        own, rest, who = (ta, rest_b, "a") if rest_b else (tb, rest_a, "b")
        if len(rest) <= len(own) and all(map(_initial, rest)) and not any(map(_initial, own)):
            return "b" if who == "a" else "a"  # the longer one only has initials besides
        if "" not in doubts or ("b" if who == "a" else "a") in doubts:
            return ""
        return who if score >= PART else who + "?"  # too common a part links nothing, but it may be meant
    if score >= LINK and "" in doubts:  # what either has besides is so common that it hardly counts
        return "a" if sum(map(weight, rest_a)) <= sum(map(weight, rest_b)) else "b"
    return ""


def token_weight(count: int, total: int) -> float:
    """What a token that ``count`` of ``total`` names have weighs: the rarer, the more."""
    return math.log(1 + total / max(1, count))


def _verified(total: int, nick: frozenset):
    """Rows (book_id, a, b, link) for candidates; the counts of their tokens come with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b, na, nb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb")), strict=True):
                usual = dict(zip(a.split() + b.split(), na + nb, strict=True))
                links.append(verify(a, b, lambda t, u=usual: token_weight(u.get(t, 1), total), usual, total, nick))
            out = pa.RecordBatch.from_arrays([batch.column("book_id"), batch.column("a"), batch.column("b"), pa.array(links, pa.string())], names=["book_id", "a", "b", "link"])
            yield out.filter(pa.array([link != "" for link in links], pa.bool_()))

    return run


def candidates(forms: DataFrame) -> DataFrame:
    """Pairs (book_id, a, b), a before b, of forms of one book that may be linked.

    The q-gram sets of the one and the other have a Jaccard similarity of SHARED at least: two such sets share a gram
    among the rarest of each, at places that leave room for the rest, so only these are joined and no such pair is
    missed. A gram that many forms of one book have is split into parts, every two of which meet in a task of their
    own. What may be a part of a longer name, however long the rest of that is, or has initials, is looked up by its
    rarest whole token, with one slip, among the tokens of the others.
    """
    d = cut(forms.select("book_id", "form").distinct().mapInArrow(_keys, "book_id string, form string, size int, variant int, keys array<string>, token string"))
    grams = d.where("variant >= 0").select("book_id", "form", "variant", F.explode("keys").alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    sets = shuffled(grams, rarity, "gram").groupBy("book_id", "form", "variant").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    sets = sets.select("book_id", "form", F.transform("g", lambda x: F.xxhash64(x["gram"])).alias("grams"), F.size("g").alias("n"))
    prefix = sets.select("*", F.posexplode(F.slice("grams", F.lit(1), F.col("n") - F.ceil(F.col("n") * SHARED).cast("int") + 1)).alias("pos", "gram"))
    prefix = cut(prefix)
    parts = prefix.groupBy("book_id", "gram").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT).select("book_id", "gram", F.ceil(F.col("rows") / HOT).cast("int").alias("parts"))
    parts = cut(parts)
    few = parts.limit(FEW_HOT + 1).count() <= FEW_HOT  # checked, so a table of hot grams that grows is joined by a shuffle
    prefix = (prefix.join(F.broadcast(parts), ["book_id", "gram"], "left") if few else shuffled(prefix, parts, ["book_id", "gram"], "left")).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("form"), F.col("parts").cast("long")).cast("int")
    prefix = prefix.withColumn("own", own)

    def side(x: str, first: bool) -> DataFrame:
        others = F.sequence("own", F.col("parts") - 1) if first else F.sequence(F.lit(0), F.col("own"))
        row, col = ("own", "meets") if first else ("meets", "own")
        e = prefix.withColumn("meets", F.explode(others))
        return e.select("book_id", "gram", F.col(row).alias("row"), F.col(col).alias("col"), *[F.col(c).alias(c + x) for c in ("form", "n", "pos", "grams")])

    room = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    need = (F.col("na") + F.col("nb")) * (SHARED / (1 + SHARED)) - 1e-6
    near = shuffled(side("a", True), side("b", False), ["book_id", "gram", "row", "col"]).where(((F.col("row") != F.col("col")) | (F.col("forma") < F.col("formb"))) & (F.col("forma") != F.col("formb")) & (room >= need))
    near = near.where(F.size(F.array_intersect("gramsa", "gramsb")) >= need)
    pair = lambda d, x, y: d.select("book_id", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    near = pair(near, "forma", "formb")
    tokens = d.where("variant < 0")
    borne = tokens.where("token is not null").select("book_id", "form", "token").distinct().groupBy("book_id", "token").agg(F.count(F.lit(1)).alias("df"))
    rarest = shuffled(tokens.where("token is not null"), borne, ["book_id", "token"]).groupBy("book_id", F.col("form").alias("part")).agg(F.min(F.struct("df", "variant", "size", "keys")).alias("m"))
    less = rarest.select("book_id", "part", F.col("m.size").alias("less"), F.explode("m.keys").alias("key"))
    wholes = tokens.where("size > 2").select("book_id", F.col("form").alias("whole"), "size", F.explode("keys").alias("key"))
    held = shuffled(less, wholes, ["book_id", "key"]).where("less < size")
    return near.unionByName(pair(held, "part", "whole")).distinct()


def _with_counts(forms: DataFrame) -> tuple[DataFrame, int]:
    """``forms`` with how many names of all books have each token, in the order of the tokens; and how many names there are."""
    named = forms.where("not alias")  # weak aliases make no token usual
    tokens = named.select("form", F.explode(F.split("form", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    each = shuffled(forms.select("book_id", "form", F.posexplode(F.split("form", " ")).alias("i", "token")), tokens, "token", "left")
    n = each.groupBy("book_id", "form").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("df", F.lit(0)).alias("df")))).alias("t"))
    return n.select("book_id", "form", F.col("t.df").alias("n")), named.count()


def links_between(forms: DataFrame, nick: frozenset = frozenset()) -> DataFrame:
    """Rows (book_id, a, b, link) for the candidates that are linked; ``forms`` has book_id, form, weak and alias, once each."""
    counts, total = _with_counts(forms)
    counts = cut(counts)
    pairs = candidates(forms)
    for x in ("a", "b"):
        pairs = shuffled(pairs, counts.select("book_id", F.col("form").alias(x), F.col("n").alias("n" + x)), ["book_id", x])
    return pairs.mapInArrow(_verified(total, nick), "book_id string, a string, b string, link string")


def same_entities(records: DataFrame) -> DataFrame:
    """Groups of records that mean the same person or organisation: (book_id, record, group_id).

    ``records`` has book_id, record (unique), name and aliases. Null, empty and generic names and aliases link nothing;
    records without a book or a usable name are in no group, nor are records that none other matches. Repeated rows
    count once. Records spelled alike in one book are linked unless the spelling is a mere form of address.
    """
    d = cut(records.where("book_id is not null and record is not null").select("book_id", "record", "name", "aliases").distinct())
    learned = forms_of_address(d)
    forms = cut(d.mapInArrow(_forms(learned), "book_id string, record string, form string, weak boolean, alias boolean").distinct())
    every_form = cut(forms.groupBy("book_id", "form").agg(F.max("weak").alias("weak"), F.min("alias").alias("alias")))
    links = cut(links_between(every_form, nicknames(forms)))

    node = lambda c: F.md5(F.concat_ws("\x01", "book_id", c))
    # an alias whose joined tokens are a full name is that name; other weak aliases are looked at in the second round
    run_together = links.where("link = 'same' and (instr(a, ' ') > 0) <> (instr(b, ' ') > 0)")
    run_together = run_together.select("book_id", F.when(F.instr("a", " ") > 0, F.col("b")).otherwise(F.col("a")).alias("form"), F.lit(True).alias("full")).distinct()
    kind = shuffled(every_form, run_together, ["book_id", "form"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    kind = cut(kind.select("book_id", "form", node("form").alias("node"), (F.col("weak") & ~F.col("full")).alias("lesser"), (F.col("alias") & ~F.col("full")).alias("aside"), "full"))
    owners = shuffled(forms.select("book_id", "record", "weak", "alias", "form"), kind.select("book_id", "form", "node", "full"), ["book_id", "form"])
    owners = owners.select("record", F.col("node").alias("form"), F.col("form").alias("text"), (F.col("weak") & ~F.col("full")).alias("weak"), (F.col("alias") & ~F.col("full")).alias("alias"))
    owners = cut(owners)
    ends = links
    for x in ("a", "b"):
        ends = shuffled(ends, kind.select("book_id", F.col("form").alias(x), F.col("node").alias("node_" + x), F.col("lesser").alias("lesser_" + x), F.col("aside").alias("aside_" + x)), ["book_id", x])
    ends = cut(ends)
    own = owners.where("not weak").select(F.col("record").alias("u"), F.col("form").alias("v"))
    sure = ends.where("link = 'same' and not aside_a and not aside_b").select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    groups = connected_components(own.unionByName(sure), "u", "v", LEAST_BLOCKS)
    groups = cut(groups.select(F.col("id").alias("form"), "group_id"))

    # what is less than a full name joins a group only if it fits just one; full names count before lesser ones
    is_a = F.col("link").startswith("a")
    pick = lambda yes, no: F.when(is_a, F.col(yes)).otherwise(F.col(no))
    fits = ends.where("link <> 'same'").select(
        pick("node_a", "node_b").alias("part"), pick("aside_a", "aside_b").alias("called"), pick("node_b", "node_a").alias("form"), pick("lesser_b", "lesser_a").alias("lesser"), pick("aside_b", "aside_a").alias("aside"),
        F.length("link").alias("doubt"),
    )
    fits = shuffled(fits.where("not aside"), groups, "form", "left").withColumn("to", F.coalesce("group_id", "form")).drop("group_id", "form", "aside")
    mine = groups.select(F.col("form").alias("part"), F.col("group_id").alias("own"))
    fits = shuffled(fits, mine, "part", "left").where("own is null or own <> to").withColumn("part", F.coalesce("own", "part"))
    fits = cut(fits.groupBy("part", "called", "to").agg(F.min("lesser").alias("lesser"), F.min("doubt").alias("doubt")))
    # a group that is part of just one other stands for that one
    up = shuffled(fits.where("not called and not lesser"), groups.select(F.col("group_id").alias("part")).distinct(), "part", "left_semi")
    up = up.groupBy("part").agg(F.min("to").alias("above"), F.max("to").alias("w"), F.min("doubt").alias("doubt")).where("above = w and doubt = 1").select(F.col("part").alias("to"), "above")
    fits = shuffled(fits, up, "to", "left").withColumn("to", F.coalesce("above", "to")).where("to <> part")
    best = fits.groupBy("part", "called").agg(F.min("lesser").alias("lesser"))
    fits = shuffled(fits, best, ["part", "called", "lesser"]).groupBy("part", "called").agg(F.min("to").alias("v"), F.count_distinct("to").alias("fit"), F.min("doubt").alias("doubt"))
    fits = cut(fits.withColumn("fit", F.when((F.col("fit") == 1) & (F.col("doubt") > 1), F.lit(2)).otherwise(F.col("fit"))))
    single = fits.where("not called and fit = 1").select(F.col("part").alias("u"), "v").unionByName(up.select(F.col("to").alias("u"), F.col("above").alias("v")))
    called = _called(owners.where("alias"), fits.where("called").select(F.col("part").alias("form"), F.col("v").alias("l"), "fit"), groups, d)
    of = lambda c: groups.select(F.col("form").alias(c), F.col("group_id").alias(f"_{c}"))
    weak_own = shuffled(shuffled(owners.where("weak and not alias"), of("record"), "record", "left"), of("form"), "form", "left")
    weak_own = weak_own.select(F.coalesce("_record", "record").alias("u"), F.coalesce("_form", "form").alias("v"))
    # only groups that are joined by something, and records known by such a part alone, take part in the second round
    late = connected_components(single.unionByName(weak_own).unionByName(called), "u", "v", LEAST_BLOCKS).select(F.col("id").alias("group_id"), F.col("group_id").alias("late"))
    late = cut(late)
    early = shuffled(groups.withColumnRenamed("form", "record"), late, "group_id", "left").select("record", F.coalesce("late", "group_id").alias("group_id"))
    alone = shuffled(late.select(F.col("group_id").alias("record"), F.col("late").alias("group_id")), groups.select(F.col("form").alias("record")), "record", "left_anti")
    every = early.unionByName(alone)
    books = d.select("record", "book_id").distinct()
    return shuffled(books, every, "record").select("book_id", "record", "group_id")


def _called(owners: DataFrame, told: DataFrame, groups: DataFrame, records: DataFrame) -> DataFrame:
    """Edges (u, v) between the group of a record with a weak alias and the one group that the alias fits.

    ``owners`` has record, form and text of such aliases, ``told`` per form the least group it fits and how many it
    fits. One that several groups besides have fits none of them, nor does one that a share of GENERIC_SHARE of all
    records has; a group whose aliases fit several others joins none.
    """
    of = groups.select(F.col("form").alias("record"), "group_id")
    owned = shuffled(owners.select("record", "form", "text"), of, "record", "left").select("form", "text", F.coalesce("group_id", "record").alias("o")).distinct()
    least = max(USUAL, GENERIC_SHARE * records.count())
    generic = owned.groupBy("text").agg(F.count_distinct("o").alias("n")).where(F.col("n") >= least).select("text")
    # what an alias fits: groups of longer forms, else records that have it as their name
    asked = shuffled(shuffled(owned, generic, "text", "left_anti"), told, "form", "left").withColumn("l", F.coalesce("l", "form"))
    asked = asked.where("coalesce(fit, 1) = 1 and o <> l")
    alone = asked.groupBy("form").agg(F.min("o").alias("u"), F.max("o").alias("w"), F.min("l").alias("v"), F.max("fit").alias("fit")).where("u = w")
    # what fits nothing can only meet a record of that name, so it doesn't count among the groups that are fitted
    one = alone.groupBy("u").agg(F.min(F.when(F.col("fit") == 1, F.col("v"))).alias("x"), F.max(F.when(F.col("fit") == 1, F.col("v"))).alias("y"))
    return shuffled(alone, one.where("x is null or x = y").select("u"), "u").select("u", "v")


def entity_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of records of one group and book, the smaller id first: (first_id, second_id)."""
    a = groups.select("book_id", "group_id", F.col("record").alias("first_id"))
    b = groups.select("book_id", "group_id", F.col("record").alias("second_id"))
    return shuffled(a, b, ["book_id", "group_id"]).where("first_id < second_id").select("first_id", "second_id").distinct()
