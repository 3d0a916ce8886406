"""Personal data in free text: found by a linear-chain conditional random field.

A lexer cuts text into tokens (words, chains of digits, addresses of mail, and
single characters of scripts without blanks). Each kind of token has features
of its word, shape and ends; what a token contributes to the score of a tag
depends on its distance, so that the score of a place is a sum over a window.
The field is trained by the driver from the small labelled table and decoded
by Viterbi over numpy batches.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.pii_table import labelled_rows
from scholia.session import spread

KINDS = ("name", "email", "phone", "id", "address")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW = 3
#: Parts of the training batches that see the whole window, the next tokens, and a token alone.
NARROWED = (0.4, 0.3, 0.3)

_AT, _DOT = r"(?:@|＠|\s?[\[(]at[\])]\s?|\sAT\s)", r"(?:\.|\s?[\[(]dot[\])]\s?|\sDOT\s)"
_WIDE = "ᄀ-ᇿ⺀-〇ぁ-ヿ㄰-㆏㐀-鿿가-힣豈-﫿"
_LETTER = "A-Za-zÀ-ÖØ-öø-ʯ\u0300-\u036fͰ-ԯԱ-֏\u0591-\u05f2\u0610-\u06ff\u0900-\u0fff\u1e00-\u1fff"
_MAIL = rf"(?P<mail>[A-Za-z0-9_%+][A-Za-z0-9._%+-]*+{_AT}[A-Za-z0-9][A-Za-z0-9-]*+(?:{_DOT}(?:[a-z0-9-]+|[A-Z0-9-]+)(?![A-Za-z]))+)|(?P<mention>@[\w-]+)|"
_REST = (
    rf"(?P<word>[{_LETTER}]++(?:['’-][{_LETTER}]++)*+(?![0-9-])[0-9]*)"
    r"|(?P<chain>[0-9]{1,3}(?:,[0-9]{3})+(?![0-9A-Za-z-])|[+＋]?[(（]?[0-9０-９]+(?:(?:[ .\-－)）(（]|[)）][ -]|[ ][(（]|[.] )?[0-9０-９]+)*(?:-[0-9０-９]{1,4}X|(?<=[0-9]{4})[A-Z]|(?<=-[0-9]{3})X)?(?![A-Za-z]))"
    r"|(?P<mixed>(?:[A-Z]{1,4}-?[0-9]+|[0-9]+[A-Z]?)(?![A-Za-z]))"
    rf"|(?P<part>[{_LETTER}]++(?:['’-][{_LETTER}]++)*+[0-9]*+)"
    rf"|(?P<handle>~[{_LETTER}0-9_]+)"
    r"|(?P<char>\S)"
)
LEXER, PLAIN_LEXER = re.compile(_MAIL + _REST), re.compile(_REST)
_MAILISH = re.compile(r"[@＠]|[\[(]at[\])]| AT ")
_DIGITS = str.maketrans("0123456789０１２３４５６７８９", "d" * 20)


def _key(group: str, token: str, before: str, beside: str) -> tuple[str, str, str, str]:
    """What tokens have in common that the field treats alike."""
    if group in ("chain", "mixed"):
        token = unicodedata.normalize("NFKC", token).translate(_DIGITS)
    elif group in ("mail", "handle", "mention"):
        token = ""
    return group, token, before, beside


def _shape(word: str) -> str:
    s = "".join("X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c if not c.isalpha() else "c" for c in word)
    return re.sub(r"(.)\1+", r"\1+", s)


@lru_cache(maxsize=2)
def common_words(paths: tuple[str, ...]) -> frozenset[str]:
    """Words in general use: the pieces of public tokenizers' vocabularies (files of fixed size) that begin a word in lower case."""
    found = set()
    for path in paths:
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip() and (piece := base64.b64decode(line.split()[0]))[:1] == b" ":
                    word = piece[1:].decode("utf-8", "ignore")
                    if len(word) > 1 and word.isalpha() and word.islower():
                        found.add(word)
    return frozenset(found)


def default_vocabulary() -> tuple[str, ...]:
    """The paths of the vocabulary files where the public tokenizers are installed, else none: words then tell by shape and ends alone."""
    try:
        import public_tokenizers
    except ImportError:
        return ()
    return tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))


def features(key: tuple[str, str, str, str], known: set[str] | None = None, common: frozenset[str] = frozenset()) -> list[str]:
    """Features of a kind of token: shape, ends, whether it is in general use and, where the table holds it often, the word itself."""
    group, token, before, beside = key
    out = [f"g={group}", f"b={before}", f"gb={group}{before}"]
    if group in ("chain", "mixed"):
        out += [f"d={token}", f"dn={token.count('d')}", f"ds={re.sub('d+', 'd', token)}", f"dl={min(len(token), 12)}{'-' in token}{' ' in token}"]
    elif group == "word":
        low, shape = token.lower(), _shape(token)
        out += [f"s={shape}", f"sb={shape}{before}", f"e={low[-3:]}", f"e4={low[-4:]}", f"p={low[:2]}", f"l={min(len(token), 9)}"]
        use = "use" if low in common else "new"
        out += ["latin" if token[0] < "ɐ" else "other", use, f"{use}={shape}", f"{use}={shape}{before}"]
        if beside:
            out += [f"pn={beside}", f"p1={beside[0]}{use}", f"n1={beside[1]}{use}", f"{shape}pn={beside}", f"{use}pn={beside}"]
        if known is None or low in known:
            out += [f"w={low}", f"W={token}"]
        else:
            out.append(f"rare={shape}")
    elif group == "char":
        out.append(f"c={unicodedata.category(token)}")
        wide = "h" if "가" <= token <= "힣" else "n" if "㐀" <= token <= "鿿" else "k" if "ぁ" <= token <= "ヿ" else ""
        out += [f"wide={wide}", f"wb={wide}{before}"]
        if known is None or token in known:
            out.append(f"w={token}")
        else:
            out.append(f"rare={wide}")
    return out


def _before(text: str, last: int, start: int) -> str:
    """How a token is set off: not at all, by a blank, or by a line break or the beginning."""
    if start == last:
        return "" if start else "n"
    if start == last + 1:
        return "n" if text[last] in "\r\n" else " "
    gap = text[last:start]
    return "n" if not last or "\n" in gap or "\r" in gap else " "


@lru_cache(maxsize=1 << 16)
def _class(token: str) -> str:
    """What a token looks like to the capitalised words beside it."""
    word = token.partition("\0")[2]
    if not word[0].isalpha():
        return "d" if word[0].isdigit() else "a" if len(word) > 1 else word
    return "l" if not word[0].isupper() else "I" if len(word) == 1 else "A" if word.isupper() else "M" if any(c.isdigit() or c.isupper() for c in word[2:]) else "C"


def _beside(tokens: list[str], begin: int) -> None:
    """Adds to each capitalised word of a text what stands before and after it."""
    classes = [_class(t) for t in tokens[begin:]]
    for i, c in enumerate(classes):
        if c in "ACIM":
            before = classes[i - 1] if i and tokens[begin + i][0] != "n" else "^"
            after = classes[i + 1] if i + 1 < len(classes) and tokens[begin + i + 1][0] != "n" else "$"
            tokens[begin + i] += "\0" + before + after


def lex(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a batch, each after the sign of how it is set off, their starts and ends, and how many each text has."""
    tokens, starts, ends, counts = [], [], [], []
    for text in texts:
        n, last = len(tokens), 0
        for m in (LEXER if _MAILISH.search(text) else PLAIN_LEXER).finditer(text):
            s, e = m.span()
            if s == last:
                tokens.append(("" if s else "n") + "\0" + m[0])
            elif s == last + 1 and text[last] == " ":
                tokens.append(" \0" + m[0])
            else:
                tokens.append(_before(text, last, s) + "\0" + m[0])
            starts.append(s)
            ends.append(e)
            last = e
        _beside(tokens, n)
        counts.append(len(tokens) - n)
    return tokens, np.array(starts, np.int32), np.array(ends, np.int32), np.array(counts, np.int64)


def _parsed(token: str) -> tuple[str, str, str, str]:
    before, word, beside = (*token.split("\0"), "")[:3]
    group = LEXER.fullmatch(word).lastgroup
    return "word" if group == "part" else group, word, before, beside


def _tags(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(len(starts), np.int64)
    for a, b, kind in spans:
        inside = np.flatnonzero((starts >= a) & (ends <= b))
        if len(inside):
            tags[inside] = TAGS.index(f"I-{kind}")
            tags[inside[0]] = TAGS.index(f"B-{kind}")
    return tags


def _allowed() -> np.ndarray:
    """0 for transitions that may be, a large penalty for I after anything but B or I of its kind."""
    pen = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, s in enumerate(TAGS):
                if s[1:] != t[1:] or s == "O":
                    pen[i, j] = -1e4
    return pen


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, longest) positions of tokens, and which of them exist."""
    begin = np.cumsum(counts) - counts
    at = np.arange(max(counts.max(), 1))
    mask = at < counts[:, None]
    return np.where(mask, begin[:, None] + at, 0), mask


class Field:
    """Weights of the field: by distance, feature and tag, and of transitions."""

    def __init__(self, index: dict[str, int], known: set[str], weights: np.ndarray, moves: np.ndarray, first: np.ndarray, common: frozenset[str] = frozenset()) -> None:
        self.index, self.known, self.weights, self.moves, self.first, self.common = index, known, weights, moves, first, common
        self._rows: dict[str, int] = {}
        self._table = np.zeros((1024, 2 * WINDOW + 1, len(TAGS)), np.float32)

    def __getstate__(self) -> tuple:
        return self.index, self.known, self.weights, self.moves, self.first, self.common

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Row of each token's kind in the table of scores, which grows with the kinds seen and is emptied at a bound."""
        if len(self._rows) > 400_000:
            self._rows.clear()
        held = self._rows
        for token in set(tokens) - held.keys():
            row = held[token] = len(held) + 1  # row 0 stands between texts
            if row >= len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            ids = [self.index[f] for f in features(_key(*_parsed(token)), self.known, self.common) if f in self.index]
            self._table[row] = self.weights[:, ids].sum(axis=1) if ids else 0
        return np.fromiter(map(held.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Score of each tag at each token: the sum over the window, never across texts."""
        at = np.arange(len(rows)) + WINDOW * (1 + np.repeat(np.arange(len(counts)), counts))
        spaced = np.zeros(len(rows) + WINDOW * (len(counts) + 1), np.int64)
        spaced[at] = rows
        scores = np.zeros((len(rows), len(TAGS)), np.float32)
        for o in range(-WINDOW, WINDOW + 1):
            scores += self._table[:, o + WINDOW][spaced[at + o]]
        return scores

    def open_runs(self, scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the runs of tokens that may have another tag than O in the best path; all others are O.

        What a stretch of other tags can gain over O is at most the sum over its
        tokens of the best score's lead and twice the best transition's lead. A
        token is certain to be O where no stretch around it can gain.
        """
        moves = self.moves + _allowed()
        gain = max(0.0, float(moves.max() - moves[0, 0]), float(self.first.max() - self.first[0]))
        lead = scores[:, 1:].max(1).astype(np.float64) - scores[:, 0] + 2 * gain
        text = np.repeat(np.arange(len(counts)), counts)
        wall = np.concatenate([[True], text[1:] != text[:-1]])
        at = np.arange(len(lead)) + np.cumsum(wall)
        walled = np.full(len(lead) + int(wall.sum()) + 1, -1e6)  # between texts nothing can pass
        walled[at] = lead
        ahead = np.cumsum(walled)
        left = ahead - np.minimum.accumulate(np.minimum(ahead, 0))
        behind = np.cumsum(walled[::-1])
        right = (behind - np.minimum.accumulate(np.minimum(behind, 0)))[::-1]
        open_ = lead + left[at - 1] + right[at + 1] >= -1e-3
        edge = np.flatnonzero(open_ & (wall | ~np.concatenate([[False], open_[:-1]])))
        stop = np.flatnonzero(open_ & np.concatenate([wall[1:] | ~open_[1:], [True]]))
        return edge, stop - edge + 1

    def decode(self, scores: np.ndarray, counts: np.ndarray, block: int = 60_000) -> np.ndarray:
        """Best tags by Viterbi over the open runs, many of similar length at a time."""
        tags = np.zeros(len(scores), np.int8)
        if not len(scores):
            return tags
        begin, sizes = self.open_runs(scores, counts)
        heads = np.zeros(len(scores) + 1, bool)
        heads[np.cumsum(counts) - counts] = True
        heads[len(scores)] = True
        moves = self.moves + _allowed()
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and sizes[order[stop]] * (stop + 1 - at) <= block:
                stop += 1
            rows = order[at:stop]
            size = int(sizes[rows[-1]])
            step_at = np.arange(size)
            mask = step_at < sizes[rows][:, None]
            where = np.where(mask, begin[rows][:, None] + step_at, begin[rows][:, None])
            best = scores[where[:, 0]] + np.where(heads[begin[rows]][:, None], self.first + _allowed()[0], moves[0])
            back = np.zeros((size, len(rows), len(TAGS)), np.int8)
            for t in range(1, size):
                step = best[:, :, None] + moves
                back[t] = step.argmax(1)
                best = np.where(mask[:, t, None], step.max(1) + scores[where[:, t]], best)
            last = np.where(heads[begin[rows] + sizes[rows]][:, None], 0, moves[:, 0])
            tag = (best + last).argmax(1).astype(np.int8)
            for t in range(size - 1, -1, -1):
                live = mask[:, t]
                tags[where[live, t]] = tag[live]
                if t:
                    tag = np.where(live, back[t, np.arange(len(rows)), tag], tag)
            at = stop
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by their place."""
    return np.stack([np.bincount(at, rows[:, k], size) for k in range(rows.shape[1])], 1).astype(np.float32)


def train(table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.18, decay: float = 2e-5, seed: int = 3, common: frozenset[str] = frozenset()) -> Field:
    """Maximum conditional likelihood by AdaGrad; ``table`` is the bounded labelled sample."""
    texts = [t for t, _ in table]
    tokens, starts, ends, counts = lex(texts)
    parsed = {t: _parsed(t) for t in set(tokens)}
    keys = [parsed[t] for t in tokens]
    begin = np.cumsum(counts) - counts
    gold = np.concatenate([_tags(starts[b : b + c], ends[b : b + c], s) for b, c, (_, s) in zip(begin, counts, table)])
    common: Counter = Counter()
    for b, c in zip(begin, counts):
        common.update({(k[1].lower() if k[0] == "word" else k[1]) for k in keys[b : b + c] if k[0] in ("word", "char")})
    known = {w for w, n in common.items() if n >= 4}
    kinds = [_key(*k) for k in keys]
    distinct = sorted(set(kinds))
    place = {k: i for i, k in enumerate(distinct)}
    lists = [features(k, known, common) for k in distinct]
    index: dict[str, int] = {}
    for fs in lists:
        for f in fs:
            index.setdefault(f, len(index))
    # Kinds of tokens by their features, as one flat list.
    flat = np.array([index[f] for fs in lists for f in fs])
    sizes = np.array([len(fs) for fs in lists])
    offset = np.cumsum(sizes) - sizes
    row = np.array([place[k] for k in kinds])
    n_tags = len(TAGS)
    w = np.zeros((2 * WINDOW + 1, len(index), n_tags), np.float32)
    moves, first = np.zeros((n_tags, n_tags), np.float32), np.zeros(n_tags, np.float32)
    seen_w, seen_m, seen_f = np.full_like(w, 1e-3), np.full_like(moves, 1e-3), np.full_like(first, 1e-3)
    allowed = _allowed()
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        # Texts of similar length share a batch; which ones, and in what order, changes.
        order = np.argsort(counts * rng.uniform(0.8, 1.25, len(counts)), kind="stable")
        order = order[counts[order] > 0]
        batches = np.array_split(order, max(1, len(order) // 160))
        for part in [batches[i] for i in rng.permutation(len(batches))]:
            # Some batches show less of the window, so that a token's own form counts where its context is new.
            reach = int(rng.choice([WINDOW, 1, 0], p=NARROWED))
            c = counts[part]
            where, mask = _padded(c)
            where = where - (np.cumsum(c) - c)[:, None] + begin[part][:, None]
            where[~mask] = 0
            tokens = row[where]
            need, inverse = np.unique(tokens[mask], return_inverse=True)
            span = [flat[offset[k] : offset[k] + sizes[k]] for k in need]
            ids = np.concatenate(span)
            owner = np.repeat(np.arange(len(need)), sizes[need])
            table_of = np.add.reduceat(w[:, ids], np.cumsum(sizes[need]) - sizes[need], axis=1)
            by_id = np.argsort(ids, kind="stable")
            used, used_at = np.unique(ids[by_id], return_index=True)
            local = np.zeros(where.shape, np.int64)
            local[mask] = inverse
            size = where.shape[1]
            emit = np.zeros((*where.shape, n_tags), np.float32)
            for o in range(-reach, reach + 1):
                a, b = max(0, -o), size - max(0, o)
                if a < b:
                    emit[:, a:b] += table_of[o + WINDOW][local[:, a + o : b + o]] * mask[:, a + o : b + o, None]
            m = moves + allowed
            forward = np.zeros_like(emit)
            forward[:, 0] = emit[:, 0] + first + allowed[0]
            for t in range(1, size):
                new = _logsum(forward[:, t - 1, :, None] + m, 1) + emit[:, t]
                forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
            total = _logsum(forward[:, -1], 1)
            backward = np.zeros_like(emit)
            pairs = np.zeros_like(moves)
            g = gold[where]
            for t in range(size - 1, 0, -1):
                inner = m + (emit[:, t] + backward[:, t])[:, None, :]
                live = mask[:, t]
                pairs += np.exp(forward[live, t - 1][:, :, None] + inner[live] - total[live, None, None]).sum(0)
                backward[:, t - 1] = np.where(live[:, None], _logsum(inner, 2), backward[:, t])
                np.add.at(pairs, (g[live, t - 1], g[live, t]), -1.0)
            grad = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
            at = np.nonzero(mask)
            grad[at[0], at[1], g[mask]] -= 1
            start = grad[:, 0].sum(0)
            for o in range(-reach, reach + 1):
                a, b = max(0, -o), size - max(0, o)
                if a >= b:
                    continue
                ok = mask[:, a + o : b + o] & mask[:, a:b]
                held = _summed(local[:, a + o : b + o][ok], grad[:, a:b][ok], len(need))
                gu = np.add.reduceat(held[owner][by_id], used_at, axis=0) / len(part) + decay * w[o + WINDOW, used]
                seen_w[o + WINDOW, used] += gu * gu
                w[o + WINDOW, used] -= rate * gu / np.sqrt(seen_w[o + WINDOW, used])
            gm, gf = pairs / len(part), start / len(part)
            seen_m += gm * gm
            seen_f += gf * gf
            moves -= rate * gm / np.sqrt(seen_m)
            first -= rate * gf / np.sqrt(seen_f)
    return Field(index, known, w, moves, first, common)


@lru_cache(maxsize=2)
def trained(rows: int = 4000, paths: tuple[str, ...] | None = None) -> Field:
    """The field trained from ``rows`` labelled rows (the bound), once in a driver; ``paths`` of vocabularies as installed unless given."""
    common = common_words(default_vocabulary() if paths is None else paths)
    return train(labelled_rows(rows, words=sorted(common)), common=common)


def _checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """A span without the punctuation around it; None where nothing else is in it."""
    while start < end and (text[start].isspace() or text[start] in ",;:.()[]（）<>\"'“”«»-–—，。；：、" and not (text[start] == "(" and kind == "phone")):
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] in ",;:.()[]（）<>\"'“”«»-–—，。；：、!?！？"):
        end -= 1
    return (start, end) if start < end else None


def spans(field: Field, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Personal data of each text: (start, end, kind) in order; null and empty texts have none."""
    filled = [t or "" for t in texts]
    tokens, starts, ends, counts = lex(filled)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(starts):
        return out
    tags = field.decode(field.emissions(field.rows(tokens), counts), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    hits = np.flatnonzero(tags)
    open_at = -1
    for j, i in enumerate(hits):
        tag = TAGS[tags[i]]
        if tag[0] == "B" or open_at < 0:
            open_at = i
        after = hits[j + 1] if j + 1 < len(hits) else -1
        if after != i + 1 or TAGS[tags[after]] != "I" + tag[1:] or text[after] != text[i]:
            row = int(text[i])
            span = _checked(filled[row], int(starts[open_at]), int(ends[i]), tag[2:])
            if span:
                out[row].append((*span, tag[2:]))
            open_at = -1
    return out


FOUND = "record_id string, span_start int, span_end int, kind string"


def personal_spans(df: DataFrame, id_column: str, text_column: str, source: str, field: Field | None = None) -> DataFrame:
    """(source_table, record_id, span_start, span_end, kind) of all personal data.

    Offsets are 0-based code points, end exclusive; spans of a text do not
    overlap. Repeated deliveries give their rows once.
    """
    model = df.sparkSession.sparkContext.broadcast(field or trained())
    schema = pa.schema([("record_id", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, found in zip(ids, spans(model.value, b.column(1).to_pylist())):
                rows += [(i, *s) for s in found]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    src = df.select(F.col(id_column).cast("string").alias("record_id"), F.col(text_column).alias("text"))
    return spread(src).mapInArrow(run, FOUND).select(F.lit(source).alias("source_table"), "record_id", "span_start", "span_end", "kind").distinct()


def masked(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """A text with [NAME], [EMAIL], [PHONE], [ID] or [ADDRESS] in place of each span, all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text_column: str, field: Field | None = None) -> Column:
    """Expression: the text with typed placeholders in place of personal data."""
    model = df.sparkSession.sparkContext.broadcast(field or trained())

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [None if t is None or t != t else t for t in s]
            yield pd.Series([masked(t, f) for t, f in zip(texts, spans(model.value, texts))], dtype=object)

    return redact(F.col(text_column))


def all_spans(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (personal_spans(*p) for p in parts))
