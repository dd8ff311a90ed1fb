"""Problem 9: sentence boundaries across languages and scripts.

Characters are tagged as the beginning of a sentence unit or inside one by a linear-chain model with
Viterbi decoding. Only characters where a unit could begin are scored (after white space or a mark;
in scripts without spaces at every character); all others are inside. The model is an averaged
structured perceptron. It is trained here, on a bounded sample of documents whose layout and marks
decide most boundaries (`clear_label`), each also in lower case, and in scripts that go without
spaces also with the marks stripped, so that the words around a boundary carry it where case or
marks are missing.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM, CJK_TERM = ".!?…。！？।؟｡．", "。！？｡．"
OPEN, CLOSE = "“„«「『（(【‘", "”»」』）)】’"
PAIR = dict(zip("“„«「『（(【", "”“»」』）)】"))
EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿️‍"
UNSPACED = "฀-๿぀-ヿ㐀-鿿豈-﫿ក-៿က-႟຀-໿"
CJK = "぀-ヿ㐀-鿿豈-﫿"

_BEHIND = rf"{re.escape(TERM + CLOSE)}\"“{EMOJI}"
#: White space behind a mark, an emoji or an unspaced script, or with a line end; behind a mark also without; between characters of CJK.
_GAP = re.compile(rf"(?<=[{_BEHIND}{UNSPACED}])\s+|(?<!\s)[^\S\r\n]*[\r\n]\s*|(?<=[{_BEHIND}])(?=\S)|(?<=[{CJK}])(?=[{CJK}A-Z])")
#: In a line without any end mark: at every white space, and where there is none between all characters of an unspaced script.
_BARE_GAP = re.compile(rf"\s+|(?<=[{CJK}])(?=[{CJK}A-Z])")
_BARE_CHARS = re.compile(rf"(?<=[{UNSPACED}])(?=[{UNSPACED}A-Z])(?![\u0e31\u0e34-\u0e3a\u0e47-\u0e4e])")
_MARK = re.compile(rf"[{re.escape(TERM)}\r\n]")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿа-яё\u0900-\U000fffff]")
_TAIL = re.compile(rf"[{re.escape(TERM + CLOSE)}\"“\s{EMOJI}]*$")
_WALL = re.compile(r"[\r\n]\s*(?:[^\W\d_a-zß-ÿа-яё]|[-*•–·\d])")
_QUOTE = re.compile(r"[“„«「『（(【”»」』）)】\"]")
_WORD = re.compile(r"[^\W_][\w'’.\-]*")
_TOKEN = re.compile(r"(?:(\S+)[ \n])?([^\s“„«「『（(【\"]+)$")
_SPACE = re.compile(r"\s")
_EMOJI, _UNSPACED, _CJK = (re.compile(f"[{x}]") for x in (EMOJI, UNSPACED, CJK))
_NO_START = re.compile(rf"[{re.escape(TERM + CLOSE)},;:،、，；：{EMOJI}]")
_LIST = re.compile(r"(?:[-*•–·]|\d{1,3}[.)])\s")

# Abbreviations that stand before what they belong to, and ones that may end a sentence.
BEFORE = set(
    "dr av no örn prof doç sn bkz mr mrs ms st jr p pp approx i.e e.g vs cf fig nr s ca z b z.b d h d.h hr fr bzw sr sra srta aprox pág n m mme mlle env p.ex "
    "т е т.е прим г-н им ул др د डॉ रु श्री ซม กก ดร co ltd şti".split()
)
EITHER = set("vb vs. etc a.m p.m u.k u.s ff usw u.a г руб д т.д т.п см кг cm mm kg m.ö м inc".split())
REPORTS = re.compile("^(?:と|って|など)")
THAI_END = re.compile("(?:ครับ|ค่ะ|คะ|นะ|จ้ะ|จ้า)$")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x370 <= o < 0x530:
        return "cased"
    if 0x590 <= o < 0x780:
        return "arab"
    if 0x900 <= o < 0xE00:
        return "indic"
    if 0xE80 <= o < 0xF00 or 0x1000 <= o < 0x10A0 or 0x1780 <= o < 0x1800:
        return "unspaced"
    return "thai" if 0xE00 <= o < 0xE80 else "cjk" if _CJK.match(c) else "other"


def _kind(c: str) -> str:
    if c.isupper():
        return "U"
    if c.islower():
        return "l"
    if c.isdigit():
        return "9"
    if c in OPEN or c == '"':
        return "q"
    return "a" if c.isalpha() else c


def _spans(text: str) -> list[tuple[int, int]]:
    """Matched quotes and brackets of any length, outermost first; ones that never close, or not before a line end that ends a unit, are no spans."""
    walls = [m.end() - 1 for m in _WALL.finditer(text)]
    stack: list[tuple[str, int]] = []
    out = []
    for m in _QUOTE.finditer(text):
        c, i = m.group(), m.start()
        k = next((k for k in range(len(stack) - 1, -1, -1) if (stack[k][0] == '"' and c == '"') or PAIR.get(stack[k][0]) == c), None)
        if k is not None:
            if bisect(walls, stack[k][1]) == bisect(walls, i):
                out.append((stack[k][1], i))
            del stack[k:]
        elif c in PAIR or c == '"':
            stack.append((c, i))
    return sorted(out)


def _short(word: str) -> str:
    """The last part of a word that a mark may shorten: digits as 9, without what is glued on before."""
    word = re.sub(r"\d+", "9", word)
    glued = max(word.rfind(c) for c in ".!?…。！？।؟")
    if glued > 3 or (glued >= 0 and word[glued] != "."):
        word = word[glued + 1 :]
    return re.search(r"[A-Za-z.9]*$", word).group() or word if _CJK.search(word) else word


class Gap:
    """A place where a unit could begin, with what the model sees there."""

    __slots__ = ("at", "bare", "emo", "left", "low", "mark", "nt", "nx", "opens", "quoted", "right", "script", "sp", "tail", "tok", "tok2")


def gaps(text: str) -> list[Gap]:
    out: list[Gap] = []
    spans = _spans(text)
    closes = {e: s for s, e in spans}
    upper = [m.start() for m in _UPPER.finditer(text) if m.group().isupper()]
    low = not upper
    bare = not _MARK.search(text.strip())
    marked = any(c in CJK_TERM for c in text)
    k, reach = 0, -1
    find = _GAP if not bare else _BARE_CHARS if not _SPACE.search(text.strip()) else _BARE_GAP
    for m in find.finditer(text):
        at, end = m.end(), m.start()
        if end == 0 or at >= len(text):
            continue
        c = text[at]
        if _NO_START.match(c):
            continue
        sp = m.group()
        prev = text[end - 1]
        breaks = "\n" in sp or "\r" in sp
        if not sp and prev in '"“' and end - 1 not in closes:
            continue
        while k < len(spans) and spans[k][0] < at:
            reach = max(reach, spans[k][1])
            k += 1
        if reach >= at:
            continue
        g = Gap()
        g.at, g.mark = at, marked
        # A place that only a line without marks has.
        g.bare = bare and (not (_CJK.match(prev) or prev in CLOSE or prev in '"“') if not sp else not (prev in CLOSE or prev in '"“' or _EMOJI.match(prev) or _UNSPACED.match(prev)))
        i = bisect_left(upper, at - 120)
        g.low = i == len(upper) or upper[i] >= at + 60
        g.sp = ("b" if sp.count("\n") > 1 else "n") if breaks else "s" if sp else ""
        back = text[max(0, end - 24) : end]
        t = _TAIL.search(back)
        first = end - (len(back) - t.start())
        raw = text[first:end]
        g.emo = bool(_EMOJI.search(raw))
        shut = [i for i in range(first, end) if i in closes]
        g.quoted = g.opens = False
        if shut:
            s = closes[shut[-1]]
            g.quoted = True
            before = text[:s].rstrip(" \t") if s < 200 else text[s - 200 : s].rstrip(" \t")
            g.opens = not before or before[-1] in TERM + "\n" + CLOSE + '"' or bool(_EMOJI.match(before[-1]))
        marks = "".join(x for x in raw if x in TERM)
        g.tail = "" if not marks else "…" if marks[-3:] == "..." or marks[-1] == "…" else marks[-1]
        ends_inside = bool(shut) and any(x in TERM for x in text[max(first, shut[-1] - 2) : shut[-1]])
        if shut and not ends_inside and not any(x in TERM for x in text[shut[-1] + 1 : end]):
            g.tail = ""
        word = _TOKEN.search(text[max(0, first - 24) : first])
        g.tok, g.tok2 = (_short(word.group(2)), word.group(1) or "") if word else ("", "")
        w = _WORD.match(text, at, at + 16)
        g.nt = re.sub(r"\d+", "9", w.group().rstrip(".").lower()) if w else text[at : at + 2]
        g.nx = "L" if _LIST.match(text, at) and breaks else _kind(c)
        g.script = _script(text[first - 1]) if first else "other"
        if g.script == "other" and g.nx == "a":
            g.script = _script(c)
        g.left, g.right = text[max(0, first - 3) : first], text[at : at + 3]
        out.append(g)
    return out


def clear_label(g: Gap, starters: Counter | None = None) -> bool:
    """Whether a unit begins here, where layout and marks decide it (labels for training)."""
    starts = starters is None or starters[g.nt] >= 2
    if g.bare:
        return False
    if g.nx == "L":
        return True
    if g.sp in ("n", "b") and g.nx != "l":
        return True
    if g.nx in "—–":
        return False
    if g.quoted and g.tail:
        return _after_quote(g, starts)
    if not g.tail:
        return _after_no_mark(g)
    if g.tail == "…":
        return g.sp != "" and g.nx in "aU" if g.script == "cjk" else g.nx != "l" or (g.low and starts)
    if g.tail == ".":
        known = _after_period(g, starts)
        if known is not None:
            return known
    return g.low if g.nx == "l" else True


def _after_quote(g: Gap, starts: bool) -> bool:
    """After a closing quote or bracket with a mark inside."""
    if g.opens:
        return (g.nx != "l" and not REPORTS.match(g.right)) or (g.low and starts)
    if g.tok and g.sp and g.script == "cased" and g.tail != ".":
        return g.nx == "U" or (g.low and g.nx == "l" and starts)
    return g.nx == "U" and g.sp != ""


def _after_no_mark(g: Gap) -> bool:
    if g.script == "thai":
        return g.sp == "s" and bool(THAI_END.search(g.tok)) and g.nx == "a"
    if g.script == "cjk":
        return g.sp == "s" and not g.mark and g.nx in "aU"
    if g.emo:
        return g.nx in "Ua"
    return g.sp == "b" and g.nx != "l"


def _after_period(g: Gap, starts: bool) -> bool | None:
    """None: the period is no part of a number or abbreviation."""
    tok = g.tok.lower()
    if g.sp == "":
        word = g.tok[-1:].isalpha() and (g.tok[-1:].islower() or g.script != "cased") and "." not in g.tok
        if not (g.nx in "Ua" and word):
            return False
    if tok.isdigit():
        return g.nx in "Uq(" and starts and bool(g.tok2) and g.tok2 != "Am"
    if tok in ("no", "nr", "n", "s", "p") and g.nx == "9":
        return False
    if tok in EITHER or (tok == "vs" and g.nx == "U"):
        return g.nx in "Uq"
    if tok in BEFORE or (len(tok) == 1 and tok.isalpha()):
        return False
    if g.script == "cjk":
        return g.sp != "" and g.nx != "9"
    return None


def features(g: Gap) -> list[str]:
    if g.bare:  # words alone; kept apart from what is learnt of marks
        out = ["B", f"B1{g.nx}|{g.low:d}", f"B2{g.nt}|{g.low:d}", f"B3{g.tok.lower()}", f"B4{g.tok.lower()}|{g.nt}", f"B5{g.tok2.lower()}|{g.tok.lower()}"]
        if g.script in ("thai", "cjk", "unspaced"):
            out += [f"Bl{g.left[-2:]}", f"Bm{g.left}", f"Br{g.right[:2]}", f"Bt{g.left[-2:]}{g.right[:2]}"]
        return out
    tok = g.tok.lower() if g.tail == "." else ""
    one = "1" if len(tok) == 1 else "d" if tok.isdigit() else "." if "." in tok else ""
    shape = f"{g.tail}|{g.sp}|{g.nx}|{g.script}|{g.quoted:d}{g.opens:d}{g.low:d}{g.emo:d}"
    out = ["b", f"0{shape}|{one}", f"1{g.sp}{g.tail}", f"2{g.tail}|{g.low:d}|{g.nt}", f"3{g.tail}|{g.sp}|{g.nx}", f"a{g.tail}|{g.nt}"]
    if g.quoted:
        out += [f"v{g.opens:d}|{g.tail}|{g.nx}|{g.script}", f"w{g.opens:d}|{g.right[:1]}", f"x{g.opens:d}|{g.nt}"]
    if tok:
        out += [f"4{tok}", f"5{tok}|{g.nx}|{g.low:d}", f"6{tok}|{g.nt}", f"7{one}|{g.nx}|{g.nt}", f"8{one}|{g.nx}|{g.low:d}|{g.script}"]
    if g.script in ("thai", "cjk"):
        k = f"{g.tail}|{g.mark:d}{g.sp}"
        out += [f"l{k}|{g.left[-2:]}", f"m{k}|{g.left}", f"r{k}|{g.right[:2]}", f"s{k}|{g.left[-1:]}{g.right[:1]}", f"t{k}|{g.left[-2:]}{g.right[:2]}", f"u{k}|{g.right[:1]}"]
    return out


class Chain:
    """Weights of the tags inside (0) and beginning (1), and of their transitions, in lines without marks apart."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}
        self.t = {bare: [[0.0, 0.0], [0.0, 0.0]] for bare in (False, True)}

    def decode(self, seq: list[list[str]]) -> list[int]:
        """Viterbi over the gaps of one document."""
        w, t = self.w, self.t[_is_bare(seq)]
        a, b, back = 0.0, -1e30, []
        for i, fs in enumerate(seq):
            s = sum(w.get(f, 0.0) for f in fs)
            if i == 0:
                a, b = 0.0, s
                back.append((0, 0))
                continue
            x0, x1, y0, y1 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
            back.append((int(x1 > x0), int(y1 > y0)))
            a, b = max(x0, x1), max(y0, y1) + s
        if not seq:
            return []
        tag = int(b > a)
        out = [tag]
        for p in reversed(back[1:]):
            tag = p[tag]
            out.append(tag)
        return out[::-1]


def _is_bare(seq: list[list[str]]) -> bool:
    return any(fs[0] == "B" for fs in seq)


def fit(data: list[tuple[list[list[str]], list[int]]], epochs: int = 12) -> Chain:
    """Averaged structured perceptron."""
    c = Chain()
    w, total = defaultdict(float), defaultdict(float)
    t_total = {bare: [[0.0, 0.0], [0.0, 0.0]] for bare in c.t}
    c.w = w
    n = 1
    for _ in range(epochs):
        wrong = 0
        for seq, gold in data:
            n += 1
            got = c.decode(seq)
            if got == gold:
                continue
            wrong += 1
            t, tt = c.t[_is_bare(seq)], t_total[_is_bare(seq)]
            for i, fs in enumerate(seq):
                if got[i] != gold[i]:
                    d = gold[i] - got[i]
                    for f in fs:
                        w[f] += d
                        total[f] += d * n
                if i:
                    for tags, d in ((gold, 1.0), (got, -1.0)):
                        t[tags[i - 1]][tags[i]] += d
                        tt[tags[i - 1]][tags[i]] += d * n
        if not wrong:
            break
    c.w = {f: v - total[f] / n for f, v in w.items() if v or total[f]}
    c.t = {k: [[c.t[k][i][j] - t_total[k][i][j] / n for j in range(2)] for i in range(2)] for k in c.t}
    return c


def _lower(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else "i" for c in text)


def _strip(text: str, starts: set[int]) -> tuple[str, set[int]]:
    """The text without its sentence marks, and where its units begin then."""
    keep, moved, n, pending = [], set(), 0, False
    for i, c in enumerate(text):
        pending = pending or i in starts
        if c in CJK_TERM or (c in "!?" and i and _UNSPACED.search(text[max(0, i - 8) : i])):
            continue
        if pending and not c.isspace():
            moved.add(n)
            pending = False
        keep.append(c)
        n += 1
    return "".join(keep), moved


def _bare(text: str, starts: set[int]) -> tuple[str, set[int]]:
    """The text as one line without end marks, and where its units begin then; marks within numbers stay."""
    keep, moved, pending = [], set(), False
    for i, c in enumerate(text):
        pending = pending or i in starts
        inside = text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit()
        if (c in TERM and not inside) or _EMOJI.match(c):
            continue
        c = " " if c in "\r\n" else c
        if c == " " and (not keep or keep[-1] == " "):
            continue
        if pending and c != " ":
            moved.add(len(keep))
            pending = False
        keep.append(c)
    return "".join(keep), moved


#: One text in so many is also learnt as a line without marks.
BARE_EVERY = 6


def training_set(texts: Iterable[str]) -> list[tuple[list[list[str]], list[int]]]:
    texts = [t for t in texts if t and t.strip()]
    seen = [(t, gaps(t)) for t in texts]
    starters: Counter = Counter()
    for t, gs in seen:
        if gs and any(c.isupper() for c in t):
            starters.update(g.nt for g in gs if g.nx == "U" and g.tail in ("!", "?", ".") and g.sp)
    data = []
    for n, (t, gs) in enumerate(seen):
        label = [int(clear_label(g, starters)) for g in gs]
        data.append(([features(g) for g in gs], label))
        starts = {g.at for g, y in zip(gs, label) if y}
        if any(c.isupper() for c in t):
            lower = gaps(_lower(t))
            data.append(([features(g) for g in lower], [int(g.at in starts) for g in lower]))
        if n % BARE_EVERY == 0 and _MARK.search(t.strip()):
            line, moved = _bare(t if n % (2 * BARE_EVERY) else _lower(t), starts)
            lg = gaps(line)
            data.append(([features(g) for g in lg], [int(g.at in moved) for g in lg]))
        if len(_UNSPACED.findall(t)) > len(t) // 2:
            bare, moved = _strip(t, starts)
            bg = gaps(bare)
            data.append(([features(g) for g in bg], [int(g.at in moved) for g in bg]))
    return data


def starts_of(text: str, model: Chain) -> list[int]:
    """Positions, from 1, where the units of a text begin."""
    body = text.lstrip()
    if not body:
        return []
    gs = gaps(text)
    tags = model.decode([features(g) for g in gs])
    first = len(text) - len(body)
    return [first + 1] + [g.at + 1 for g, y in zip(gs, tags) if y and g.at > first]


#: Documents that the model is trained on, at most.
SAMPLE = 3000


def train_on(docs: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fits the model on at most ``sample`` documents, evenly over the languages, chosen by hash."""
    lang = F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2)) if "lang" in docs.columns else F.lit("")
    pool = docs.where("text is not null and text <> ''").select(lang.alias("l"), "text", F.xxhash64("text").alias("h")).where(F.length("text") < 2000)
    each = pool.groupBy("l").agg(F.count("*").alias("n"))
    share = max(1, sample // max(1, min(each.count(), 16)))
    rate = each.select("l", F.least(F.lit(1.0), F.lit(2.0 * share) / F.col("n")).alias("r"))
    near = pool.join(F.broadcast(rate.orderBy(F.desc("r")).limit(256)), "l").where(F.pmod(F.col("h"), F.lit(1_000_003)) < F.col("r") * 1_000_003)
    rows = near.select("l", "h", "text").distinct().orderBy("h").limit(sample).collect()
    return fit(training_set(r["text"] for r in sorted(rows, key=lambda r: r["h"])))


def _tagged(docs: DataFrame, model: Chain | None, units: bool) -> DataFrame:
    model = model or train_on(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.t))  # as large as the training sample allows

    def tag(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Chain()
        m.w, m.t = shared.value
        for p in parts:
            texts = [t if isinstance(t, str) else "" for t in p["text"]]
            found = [starts_of(t, m) for t in texts]
            out = {"doc_id": p["doc_id"].astype("Int64").repeat([len(f) for f in found]).to_numpy(), "start_pos": [x for f in found for x in f]}
            if units:
                out["unit"] = [t[a - 1 : b - 1].strip() for t, f in zip(texts, found) for a, b in zip(f, [*f[1:], len(t) + 1])]
            yield pd.DataFrame(out)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text <> ''")
    return rows.mapInPandas(tag, "doc_id bigint, start_pos int" + ", unit string" * units)


def sentence_starts(docs: DataFrame, model: Chain | None = None) -> DataFrame:
    """doc_id, start_pos: where each sentence unit of documents.text begins, counted from 1.

    Defined results: null, empty and blank texts have no units; a text of any length is read whole;
    a document given twice comes out twice; a null doc_id is kept.
    """
    return _tagged(docs, model, units=False)


def sentence_units(docs: DataFrame, model: Chain | None = None) -> DataFrame:
    """doc_id, start_pos, unit: the units themselves, without white space around."""
    return _tagged(docs, model, units=True)
