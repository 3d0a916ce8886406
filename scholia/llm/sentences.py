"""Sentence units of documents in many languages, scripts and layouts.

Two machines in a row. A scanner turns a text
into a short string of events (possible ends of sentences, paired quotes and
brackets, kinds of line break), each judged by what stands next to it. A
transducer reads the events and says where units start; its state is what no
local look can tell: how deep in quotes and brackets the text is, to any depth,
and whether it is in a signature.

The events of a whole batch, with a mark between documents, are cut into
chunks of equal length. Every chunk is a function from states to states, kept
as three numbers (what it adds to the depth, the least depth it leaves, and what
it makes of the signature); the functions are composed by a parallel prefix
scan, and a second run from the states thus known gives the output. A long
document is no slower than as many short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import spread

# Abbreviations after which a sentence does not end.
OPEN_ABBREVIATIONS = {
    "e.g", "i.e", "cf", "vs", "w.r.t", "approx", "ca", "sec", "secs", "sect", "fig", "figs", "eq", "eqs", "eqn", "tab", "tabs", "app", "thm", "alg", "def", "lem", "prop", "cor", "no", "nos", "pp", "p",
    "vol", "ch", "chap", "ref", "refs", "dr", "prof", "mr", "mrs", "ms", "st", "al", "apt", "p.o", "resp", "viz", "incl", "dev", "z.b", "u.a", "d.h", "bzw", "vgl", "nr", "abb", "s.o", "evtl", "sog", "z", "u",
    "env", "art", "m", "mme", "mlle", "p.ej", "ej", "pág", "págs", "sr", "sra", "srta", "núm", "т", "т.е", "т.д", "т.п", "рис", "табл", "см", "стр", "гл", "ср", "напр", "г", "डॉ", "श्री", "प्रो",
}

# Abbreviations after which a sentence may end if the next word looks like a beginning.
CLOSED_ABBREVIATIONS = {"etc", "u.s", "u.k", "u.s.a", "e.u", "a.m", "p.m", "i.i.d", "inc", "ltd", "corp", "co", "jr", "ph.d", "usw", "и т.д", "min", "max", "avg", "est"}

# Abbreviations of states, which end a sentence only before a word that can open one.
STATES = {"u.s", "u.k", "u.s.a", "e.u", "u.n"}

# English words other than names that open sentences.
OPENING = set(
    "a about according after all also although an and another any are as at be because before being besides both but by can could despite do does due during each even every few finally first for from further given had has have he hence here how i if in indeed instead is it its last lastly least less like many may more moreover most much my "
    "neither next no nor not nothing now of on once one only or other others our overall please rather same second several she should since so some still such than that the their then there therefore these they third this those though through thus to too two under unless until up upon was we well were what when where whereas whether which while who why will with within without would yes yet you your major minor".split()
)

# Names of months that follow an ordinal written with a full stop.
MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"}

# Formulas that close a letter; the lines after one are a signature.
CLOSINGS = {
    "thanks", "thank you", "many thanks", "best", "best regards", "best wishes", "kind regards", "warm regards", "regards", "sincerely", "yours sincerely", "cheers", "cordially",
    "mit freundlichen grüßen", "viele grüße", "beste grüße", "freundliche grüße", "cordialement", "bien cordialement", "saludos", "un saludo", "atentamente", "с уважением", "감사합니다", "감사드립니다", "此致", "此致敬礼", "谢谢", "敬具", "よろしくお願いします", "よろしくお願いいたします", "मंगलकामनाओं सहित", "धन्यवाद", "مع التحية", "شكرا", "ขอบคุณ", "ขอแสดงความนับถือ",
}

# Names of review sections.
SECTIONS = {"summary", "strengths", "weaknesses", "questions", "limitations", "soundness", "evaluation", "minor comments", "major comments", "comments", "presentation", "contribution", "originality", "significance", "clarity", "quality", "recommendation", "conclusion", "review", "rating", "confidence", "details", "ethics", "reproducibility", "strengths and weaknesses"}

# Words that a heading neither begins nor ends with.
RUNNING = {"the", "a", "an", "as", "at", "to", "in", "on", "of", "for", "and", "or", "is", "are", "was", "it", "this", "that", "there", "why", "how", "what", "could", "my", "i", "all", "no", "well", "after", "compared", "moreover", "unfortunately", "st", "la", "le", "les", "el", "los", "der", "die", "das", "un", "une", "l'article", "pourquoi", "según", "insgesamt", "warum", "für", "к", "на", "код", "far", "can", "same", "time", "said", "more", "importantly", "authors", "paper"}

# Words that begin a greeting.
GREETING = re.compile(r"(?:dear|hello|hi|greetings|hallo|liebe[rs]?|sehr geehrte[rs]?|chers?|chères?|bonjour|estimad[oa]s?|hola|уважаем\w+|здравствуйте|안녕하세요|존경하는|尊敬的|您好|拝啓|السادة|प्रिय|เรียน)(?![^\W\d_])[^.?;\r\n]{0,60}[,!:，！：]", re.I)

SOFT, STRONG = ".!?…", "。！？｡।॥؟۔"
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "［": "］", "｢": "｣"}
OPENERS, CLOSERS = frozenset(PAIRS), frozenset(PAIRS.values())
CLOSING_SIGNS = CLOSERS | frozenset("\"'’*_")
WIDE = "⺀-鿿豈-﫿＀-￯"
EVENT = re.compile(
    r"(?P<n>[^\S\r\n\v\f\x1c-\x1e\x85  ]*(?:[\r\n\v\f\x85  ])\s*)"
    rf"|(?P<t>[{SOFT}{STRONG}]+)"
    r"|(?P<q>[\"“”„«»‹›「」『』()\[\]（）【】《》〈〉［］｢｣])"
    r"|(?P<b>(?<=[ก-๛])[^\S\r\n]+|[^\S\r\n]+(?=[ก-๛]))"
)
MARKER = re.compile(r"(?:[-*•‣◦▪·–—][^\S\r\n]+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})\)[^\S\r\n]+|\d{1,3}\.[^\S\r\n]+|[①-⑳]\s*)(?=\S)")
HEADING = re.compile(r"#{1,6}[^\S\r\n]+\S.*|(\*\*|__)(?:(?!\1).)+\1:?|\[[^\]\r\n]{1,60}\]:?|【[^】\r\n]{1,60}】")
CONTACT = re.compile(r"(?:☎ ?|[^\W\d_.-]{2,12}\.?[:：]? ?)?(?:[\w.+-]+[@＠]\S+\.\w+|\+?[\d(][\d ()/.-]{6,})")
ATTACHED = re.compile(f".*[{WIDE}가-힣]")
BREAKING = frozenset("\"“”„«»‹›「」『』()[]（）【】《》,;:!?…。")
LAST_WORD = re.compile(r"[^\s\"“”„«»‹›「」『』()\[\]（）【】《》,;:!?…。]+\Z")
#: Lines are not taken to be wrapped at fewer characters than this.
LEAST_WIDTH = 45
#: No abbreviation is longer.
LONGEST = 24

# The transducer. State: depth of quotes and brackets, and whether in a signature.
CLASSES = ("document", "hard", "end", "open", "close", "line", "wrap", "closing")
DOCUMENT, HARD, END, OPEN, CLOSE, LINE, WRAP, CLOSING = range(len(CLASSES))


#: What each class adds to the depth and the least depth after it; far below 0 is a reset.
RESET = -(1 << 40)
ADDS = np.array([RESET if c in (DOCUMENT, HARD, CLOSING) else 1 if c == OPEN else -1 if c == CLOSE else 0 for c in range(len(CLASSES))], np.int64)
#: Whether text behind it is in a signature: 0 no, 1 yes, 2 as before.
SIGNS = np.array([0 if c in (DOCUMENT, HARD) else 1 if c == CLOSING else 2 for c in range(len(CLASSES))], np.int8)


def step(depth: np.ndarray, signed: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, signed, does a unit start) after an event: the boundary rules."""
    free = depth == 0
    starts = (event == DOCUMENT) | (event == HARD) | (event == CLOSING) | (event == END) & free | (event == LINE) & (signed | free) | (event == WRAP) & signed
    kept = SIGNS[event]
    return np.maximum(depth + ADDS[event], 0), np.where(kept == 2, signed, kept == 1), starts


def transduce(events: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Output of the transducer for each event, from depth 0 outside a signature, by chunk functions and a prefix scan."""
    n = len(events)
    if not n:
        return np.zeros(0, bool)
    chunk = max(1, min(chunk, int(np.sqrt(n)) + 1))
    chunks = -(-n // chunk)
    grid = np.full(chunks * chunk, OPEN, np.int8)  # padding after the last event changes no output
    grid[:n] = events
    grid = grid.reshape(chunks, chunk)
    # A chunk takes depth d to max(d + add, least) and leaves the signature as it is (2) or sets it.
    add, least, sign = np.zeros(chunks, np.int64), np.zeros(chunks, np.int64), np.full(chunks, 2, np.int8)
    for t in range(chunk):
        c = grid[:, t]
        add, least = np.maximum(add + ADDS[c], RESET), np.maximum(least + ADDS[c], 0)
        sign = np.where(SIGNS[c] == 2, sign, SIGNS[c])
    gap = 1
    while gap < chunks:  # inclusive scan: chunk i becomes the function of chunks 0 to i
        new_least = np.maximum(least[:-gap] + add[gap:], least[gap:])
        new_add = np.maximum(add[:-gap] + add[gap:], RESET)
        new_sign = np.where(sign[gap:] == 2, sign[:-gap], sign[gap:])
        add, least, sign = np.concatenate([add[:gap], new_add]), np.concatenate([least[:gap], new_least]), np.concatenate([sign[:gap], new_sign])
        gap *= 2
    depth = np.concatenate([[0], np.maximum(add, least)[:-1]])
    signed = np.concatenate([[False], sign[:-1] == 1])
    out = np.zeros((chunks, chunk), bool)
    for t in range(chunk):
        depth, signed, out[:, t] = step(depth, signed, grid[:, t])
    return out.reshape(-1)[:n]


def _paired(tokens: list[tuple[int, str]]) -> dict[int, int]:
    """Which of a paragraph's quotes and brackets open (OPEN) or close (CLOSE) a pair; others are left out."""
    stack: list[tuple[str, int]] = []
    kinds: dict[int, int] = {}
    for at, c in tokens:
        wanted = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c), None)
        if wanted is not None:
            kinds[stack[wanted][1]], kinds[at] = OPEN, CLOSE
            del stack[wanted:]
        elif c in OPENERS:
            stack.append((PAIRS[c], at))
        elif c == '"':
            stack.append(('"', at))
    return kinds


def _begins(text: str, at: int) -> bool:
    """Whether a lower-case word looks like the beginning of a sentence: k-means, iSolve."""
    return text[at + 1 : at + 2] == "-" and text[at + 2 : at + 3].isalpha() or text[at + 1 : at + 2].isupper()


class Before:
    """The word before a mark, of letters attached to a script without spaces only themselves; marks are asked for in order.

    Of a word longer than any abbreviation the last letters are given, and what
    else it holds (@, / or a dot) is known from the part seen before.
    """

    def __init__(self, text: str) -> None:
        self.text, self.begin, self.seen, self.holds = text, 0, 0, ""

    def __call__(self, at: int) -> tuple[str, str]:
        """(the word or its end, which of the signs @ / . it holds)."""
        text, i = self.text, at
        attached = at > 0 and text[at - 1].isascii()
        while i > 0 and not text[i - 1].isspace() and text[i - 1] not in BREAKING and not (attached and _unspaced(text[i - 1])):
            i -= 1
            if i == self.seen and self.begin < i:  # the rest was looked at before
                held = self.holds + "".join(c for c in "@/." if c in text[i:at])
                i = self.begin
                break
        else:
            held = "".join(c for c in "@/." if c in text[i:at])
        self.begin, self.seen, self.holds = i, at, "".join(dict.fromkeys(held))
        return text[max(i, at - LONGEST) : at], self.holds


def _unspaced(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "＀" <= c <= "￯" or "가" <= c <= "힣"


def _ends(text: str, start: int, stop: int, closed: bool, before: Before) -> int:
    """Where the next unit starts if a sentence may end with the run at start..stop, else -1.

    ``stop`` is behind any closing signs; ``closed`` says that there are some.
    """
    size, at = len(text), stop
    while at < size and text[at].isspace():
        at += 1
    if at == size:
        return -1
    gap, c = at > stop, text[at]
    run = text[start : start + 8]
    wide = "⺀" <= c <= "鿿" or "＀" <= c <= "￯"
    if run[0] in STRONG or (len(run) > 1 and run[0] in SOFT and run[1] in STRONG):
        if gap or not closed:
            return at if c not in ",;:，、；：" else -1
        return -1 if "぀" <= c <= "ゟ" or c in "，、；：,;:。" or "가" <= c <= "힣" else at
    if c in ",;:，、；：%)" or (c in SOFT and not gap):
        return -1
    end = start
    while end < size and text[end] in SOFT:
        end += 1
    run = text[start:end]
    asks = "?" in run or "!" in run
    dots = "…" in run or run.startswith("..")
    if not gap:
        # Attached: only where the script or a capital shows a beginning.
        if wide or "ก" <= c <= "๛":
            return at if not closed or c not in "，、；：" else -1
        word, holds = before(start)
        if closed and not asks and c.isalpha() and not c.isupper():
            return -1
        if "가" <= c <= "힣":
            return at if not closed and word and ("가" <= word[-1] <= "힣") else -1
        begins = c.isupper() and (text[at + 1 : at + 2].islower() or text[at + 1 : at + 2] == " ") or (c.islower() and _begins(text, at) and text[at + 2 : at + 3].isalpha())
        if c in OPENERS and at > 0 and not closed and text[at + 1 : at + 2].isupper():
            begins = True
        if not begins or dots:
            return -1
        if asks or closed:
            return at
        if word.lower() in OPEN_ABBREVIATIONS or "@" in holds or "/" in holds or len(word) < 2 or ("." in holds and word.lower() not in CLOSED_ABBREVIATIONS and not word[-1].isdigit()):
            return -1
        following = re.match(r"[\w.+-]*@?", text[at : at + 64])
        return at if (word[-1].islower() or word[-1].isdigit() or not word[-1].isupper()) and not (following and following.group().endswith("@")) else -1
    lower = c.islower()
    if asks:
        return -1 if lower and closed and not _begins(text, at) else at
    begins = not lower or _begins(text, at)
    if dots:
        return at if begins and (closed or start == 0 or not text[start - 1].isspace()) else -1
    if closed:
        # A closing bracket after an abbreviation, as in (Velquist Inc.) keeps.
        return at if begins else -1
    word, holds = before(start)
    low = word.lower().lstrip("*_'’-")
    if low in OPEN_ABBREVIATIONS:
        return -1
    if low in STATES and c.isupper():
        following = re.match(r"[^\W\d_]+", text[at : at + 24]).group()
        return at if following[0] > "ɏ" or following.lower() in OPENING or following.endswith(("ly", "ing", "ed")) or following.isupper() and len(following) == 1 else -1
    if low in CLOSED_ABBREVIATIONS:
        return at if begins else -1
    if len(word) == 1 and word.isalpha() and not ("぀" <= word <= "힣"):
        return -1 if word.isupper() or lower else at
    if word and "가" <= word[-1] <= "힣":
        return at  # a verb's ending before a Latin word in lower case
    if word.isdigit():
        if lower and not _begins(text, at):
            return -1
        following = re.match(r"[^\W\d_]+", text[at : at + 12])
        if following and following.group().lower() in MONTHS and len(word) < 3:
            return -1
        line = text.rfind("\n", 0, start - len(word))
        if not text[max(line + 1, start - len(word) - 3) : start - len(word)].strip() and start - len(word) - line <= 4 and len(word) < 4:
            return -1  # the number of a list item
        return at
    if lower and not _begins(text, at):
        return at if len(low) > 3 and "." not in holds and low.isalpha() else -1
    return at


def _line_kind(a: str, b: str, width: int, opening: bool) -> int:
    """The kind of a single line break between two lines; ``opening``: the first is the first of the text, which may be cut."""
    if HEADING.fullmatch(a) or HEADING.fullmatch(b) or GREETING.fullmatch(a) or a.rstrip(":： ").casefold() in SECTIONS or b.rstrip(":： ").casefold() in SECTIONS:
        return HARD
    if a.rstrip(" ,.!،、，。！").casefold() in CLOSINGS or b.rstrip(" ,.!،、，。！").casefold() in CLOSINGS:
        return CLOSING
    last = a[-1:]
    if MARKER.match(b) and (MARKER.match(a) or last in SOFT or last in STRONG or last in CLOSING_SIGNS or last == ":" or len(a) + 1 + len(b.split(None, 2)[1] if len(b.split(None, 2)) > 1 else b) < width - 20):
        before = LAST_WORD.search(a[:-1]) if last == "." else None
        if not (before and before.group().lower() in OPEN_ABBREVIATIONS):
            return HARD
    if last in SOFT or last in STRONG or (last in CLOSING_SIGNS and len(a) > 1):
        return WRAP  # the end of a sentence, if it is one, is judged by its mark
    first = b.split(None, 1)[0]
    if re.match(f"[{WIDE}ก-๛가-힣]", first):
        first = first[:6]
    if CONTACT.fullmatch(a) or CONTACT.fullmatch(b):
        return LINE
    if b[0] in ",;:)»”.!?、，。" or len(a) + 1 + len(first) > width:
        return WRAP
    if "ก" <= a[-1] <= "๛" or "ก" <= b[0] <= "๛":
        return LINE
    if _titled(a, b):
        return LINE
    return WRAP if opening or 5 * len(a) > 3 * width or b[0].islower() else LINE


def _titled(a: str, b: str) -> bool:
    """Whether a line without marks is a heading of what follows: few words, none that a sentence would go on from."""
    if a[-1] == ":":
        return b[0] not in "\"“„«「"
    words = a.split()
    return len(words) <= 4 and a[0].isupper() and a[-1] not in ",;" and words[-1].lower() not in RUNNING and words[0].lower() not in RUNNING and not b[0].islower() and (len(words) == 1 or a.isupper() or not any(w[0].isupper() for w in words[1:])) and all(w.isalpha() and not any(c.isupper() for c in w[1:]) or w.isupper() for w in words)


def scan(text: str) -> tuple[list[int], list[int]]:
    """Events of a text: their classes, and for each where a unit would start."""
    kinds, places = [], []
    tokens = [(m.lastgroup, m.start(), m.end()) for m in EVENT.finditer(text)]
    size = len(text)
    quotes: list[tuple[int, str]] = []
    paired: dict[int, int] = {}
    before = Before(text)
    # The width to which the lines of each paragraph are wrapped.
    widths: list[int] = []
    width = begin = 0
    for group, s, e in tokens:
        if group == "q":
            quotes.append((s, text[s]))
        elif group == "n":
            width, begin = max(width, s - begin), e
            if _blank(text, s, e):
                widths.append(max(LEAST_WIDTH, width))
                width = 0
                if quotes:
                    paired.update(_paired(quotes))
                    quotes = []
    if quotes:
        paired.update(_paired(quotes))
    widths.append(max(LEAST_WIDTH, width, len(text.rstrip()) - begin))
    paragraph = 0
    line = 0
    for group, s, e in tokens:
        if group == "t":
            stop = e
            while stop < size and text[stop] in CLOSING_SIGNS and stop not in paired:
                stop += 1
            nxt = stop
            while nxt < size and text[nxt].isspace():
                nxt += 1
            if paired.get(nxt) == CLOSE:
                continue  # judged behind the closing sign
            at = _ends(text, s, stop, stop > e, before)
            if at >= 0:
                kinds.append(END)
                places.append(at)
        elif group == "q":
            kind = paired.get(s)
            if kind is None:
                continue
            kinds.append(kind)
            places.append(s)
            if kind == CLOSE:
                back = s - 1
                while back > 0 and (text[back].isspace() or text[back] in CLOSING_SIGNS):
                    back -= 1
                if text[back] in SOFT or text[back] in STRONG:
                    stop = e
                    while stop < size and text[stop] in CLOSING_SIGNS and stop not in paired:
                        stop += 1
                    if paired.get(stop) == CLOSE:
                        continue
                    begin = back
                    while begin > 0 and (text[begin - 1] in SOFT or text[begin - 1] in STRONG):
                        begin -= 1
                    at = _ends(text, begin, stop, True, Before(text))
                    if at >= 0:
                        kinds.append(END)
                        places.append(at)
        elif group == "b":
            marked = MARKER.match(text, line, e + 1)
            if marked and marked.end() == e:
                continue  # the marker of a list item
            kinds.append(END)
            places.append(e)
        else:
            blank = _blank(text, s, e)
            if e < size:
                if blank:
                    kind = HARD
                else:
                    stop = e
                    while stop < size and text[stop] not in "\r\n\v\f\x85  ":
                        stop += 1
                    kind = _line_kind(text[line:s].strip(), text[e:stop].strip(), widths[paragraph], not text[:line].strip())
                kinds.append(kind)
                places.append(e)
                if kind == HARD:
                    stop = e
                    first = re.compile(r"[^\r\n]*").match(text, e).group().rstrip()
                    if first.rstrip(" ,.!،、，。！").casefold() in CLOSINGS:
                        kinds.append(CLOSING)
                        places.append(e)
            paragraph += blank
            line = e
    return kinds, places


def _blank(text: str, s: int, e: int) -> bool:
    """Whether a run of line breaks holds a blank line."""
    run = text[s:e].replace("\r\n", "\n")
    return sum(c in "\r\n\v\f\x85  " for c in run) > 1


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all units of a batch of texts, in order; null and blank texts have none."""
    kinds: list[int] = []
    places: list[int] = []
    rows: list[int] = []
    for row, text in enumerate(texts):
        if not text or text.isspace():
            continue
        k, p = scan(text)
        begin = len(text) - len(text.lstrip())
        kinds.append(DOCUMENT)
        places.append(begin)
        first = re.compile(r"[^\r\n]*").match(text, begin).group()
        if "\n" in text and first.rstrip(" ,.!،、，。！").casefold() in CLOSINGS:
            kinds.append(CLOSING)
            places.append(begin)
            rows.append(row)
        kinds += k
        places += p
        rows += [row] * (len(k) + 1)
    starts = transduce(np.array(kinds, np.int8))
    row, place = np.array(rows, np.int64)[starts], np.array(places, np.int64)[starts]
    if len(row):
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])
        row, place = row[new], place[new]
    stop = np.empty_like(place)
    for i in range(len(row)):
        text = texts[row[i]]
        end = place[i + 1] if i + 1 < len(row) and row[i + 1] == row[i] else len(text)
        while end > place[i] and text[end - 1].isspace():
            end -= 1
        stop[i] = end
    keep = stop > place
    return row[keep], place[keep], stop[keep]


def sentence_units(df: DataFrame, id_column: str, text_column: str, source: str) -> DataFrame:
    """(source_table, record_id, unit_start, unit_end), one row per unit of every text.

    Offsets are 0-based code points, end exclusive. Null, empty and blank texts
    give no rows; repeated deliveries give their rows once. Rows are mapped one
    by one, so nothing but the short result rows is shuffled.
    """
    out = pa.schema([("record_id", pa.string()), ("unit_start", pa.int32()), ("unit_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, stop = units(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)).cast(pa.string()), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], schema=out)

    src = df.select(F.col(id_column).cast("string").alias("record_id"), F.col(text_column).alias("text"))
    found = spread(src).mapInArrow(run, "record_id string, unit_start int, unit_end int")
    return found.select(F.lit(source).alias("source_table"), "record_id", "unit_start", "unit_end").distinct()


def all_units(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (sentence_units(*p) for p in parts))
