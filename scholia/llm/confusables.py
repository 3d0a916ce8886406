"""Visually identical text brought to one form.

The form of a text is found token by token. A weighted edit automaton walks a
trie of known words of many scripts: what cannot be seen and letters that always
look the same cost nothing, letters that look the same only to a reader who
knows the word (``DOUBTFUL``) cost a little, every other edit more than is ever
allowed. A disguised token so reaches the word it reads as, whose spelling is
taken; whether a doubtful letter stands for another is decided by the words that
exist. Tokens that reach no word, or two equally well, are normalised by a table.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import cut, spread

# Letters of other scripts that look like Latin letters.
LATIN_LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y", "ӏ": "l", "Ӏ": "I",
    # Armenian
    "Ս": "U", "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ք": "p",
}

# Ligatures of type and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ſ": "s", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ"}

# Kinds of space and of hyphen, and signs that are the same under another code.
SPACES = "               　"
HYPHENS = "‐‑﹣－"
EQUIVALENT = {"µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϵ": "ε", "∆": "Δ", "∑": "Σ", "∏": "Π", "∕": "/", "⁄": "/", "∶": ":", "ʼ": "'", "ˈ": "'", "․": "."}

# Ranges of characters that cannot be seen.
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]


# Letters that look like others in some words only, each with the letters it may stand for.
DOUBTFUL = {
    # Greek
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ρ": "p", "σ": "o", "τ": "t", "υ": "uv", "χ": "x", "ω": "w", "β": "B",
    # Cyrillic
    "к": "k", "м": "m", "т": "tm", "н": "h", "в": "b", "г": "r", "и": "u", "п": "n", "ь": "b", "ґ": "r", "є": "e", "ѵ": "v", "ԍ": "g", "З": "3", "б": "b6",
    # Armenian, Cherokee, Coptic
    "ռ": "n", "ր": "r", "լ": "l", "ա": "w", "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮋ": "H", "Ꮇ": "M", "Ꮃ": "W", "Ꮪ": "S", "Ꮯ": "C", "Ꮲ": "P", "Ꮤ": "W", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Latin letters of phonetic and other alphabets
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "L", "ɴ": "N", "ʀ": "R", "ᴀ": "A", "ᴄ": "c", "ᴇ": "E", "ᴏ": "o", "ᴛ": "T", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ʋ": "v", "ɯ": "w", "ƿ": "p", "ƅ": "b", "ꞓ": "c", "ꜱ": "s",
}


def _table() -> dict[int, str]:
    """What each character is read as, on decomposed text; '' for what cannot be seen."""
    table = {ord(c): s for c, s in {**LATIN_LOOK_ALIKES, **LIGATURES, **EQUIVALENT}.items()}
    table |= {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
    for c in range(0xFF01, 0xFFEF):  # full- and half-width forms
        wide = unicodedata.normalize("NFKC", chr(c))
        if wide != chr(c) and c not in table:
            table[c] = unicodedata.normalize("NFD", wide)
    for lo, hi in INVISIBLE:
        table |= dict.fromkeys(range(lo, hi + 1), "")
    return table


TABLE = _table()
TOUCHED = re.compile("[^\x00-\x7f]")
LETTERS = re.compile(r"[^\W\d_]+")

#: Letters that Cyrillic or Greek share with Latin by look, the other way round.
_BACK = {"cyrillic": {}, "greek": {}}
for _c, _l in LATIN_LOOK_ALIKES.items():
    if "Ѐ" <= _c <= "ԯ" and _l not in _BACK["cyrillic"]:
        _BACK["cyrillic"][_l] = _c
    elif "Ͱ" <= _c <= "Ͽ" and _l not in _BACK["greek"]:
        _BACK["greek"][_l] = _c
_OWN = {
    "cyrillic": re.compile("[" + "".join(c for c in map(chr, range(0x400, 0x530)) if c not in LATIN_LOOK_ALIKES and c.isalpha()) + "]"),
    "greek": re.compile("[" + "".join(c for c in map(chr, range(0x370, 0x400)) if c not in LATIN_LOOK_ALIKES and c.isalpha() and c != "μ") + "]"),
}
_LATIN_ONLY = re.compile("[" + "".join(sorted(c for c in map(chr, range(65, 123)) if c.isalpha() and c not in _BACK["cyrillic"] and c not in _BACK["greek"])) + "]")


def skeleton(text: str) -> str:
    """What a text is read as: the table applied to its decomposed form."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(TABLE))


def respelled(word: str) -> str:
    """A skeleton's word in the one script that its own letters belong to; a function of the skeleton alone."""
    for script in ("cyrillic", "greek"):
        if _OWN[script].search(word) and not _LATIN_ONLY.search(word):
            return unicodedata.normalize("NFC", "".join(_BACK[script].get(c, c) for c in unicodedata.normalize("NFD", word)))
    return word


#: Costs of the automaton: of a doubtful letter and of any other edit.
DOUBT, EDIT = 1, 4


class Trie:
    """Known words, as nested maps over what their letters are read as; '' marks a word's end with its one spelling."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            read = skeleton(w)
            node = self.root
            for c in unicodedata.normalize("NFD", read):
                node = node.setdefault(c, {})
            node[""] = respelled(read)

    def match(self, token: str, budget: int = 0) -> tuple[int, str] | None:
        """(cost, word) of the cheapest word within ``budget``; None if there is none or two are equally cheap."""
        states: dict[int, tuple[int, dict]] = {id(self.root): (0, self.root)}
        states = self._inserted(states, budget)
        for c in unicodedata.normalize("NFD", token):
            read, doubt = TABLE.get(ord(c), c), DOUBTFUL.get(c, "") if budget >= DOUBT else ""
            if read == "":
                continue
            new: dict[int, tuple[int, dict]] = {}
            for cost, node in states.values():
                ahead = node
                for r in read:
                    ahead = ahead.get(r)
                    if ahead is None:
                        break
                if ahead is not None:
                    self._keep(new, cost, ahead)
                for r in doubt:
                    if r in node and cost + DOUBT <= budget:
                        self._keep(new, cost + DOUBT, node[r])
                if cost + EDIT <= budget:
                    self._keep(new, cost + EDIT, node)
                    for r, child in node.items():
                        if r:
                            self._keep(new, cost + EDIT, child)
            states = self._inserted(new, budget)
            if not states:
                return None
        ends = sorted({(cost, node[""]) for cost, node in states.values() if "" in node})
        return ends[0] if ends and (len(ends) == 1 or ends[1][0] > ends[0][0]) else None

    @staticmethod
    def _keep(states: dict, cost: int, node: dict) -> None:
        held = states.get(id(node))
        if held is None or cost < held[0]:
            states[id(node)] = (cost, node)

    def _inserted(self, states: dict, budget: int) -> dict:
        todo = list(states.values()) if budget >= EDIT else []
        while todo:
            cost, node = todo.pop()
            if cost + EDIT <= budget:
                for r, child in node.items():
                    if r and (id(child) not in states or states[id(child)][0] > cost + EDIT):
                        states[id(child)] = (cost + EDIT, child)
                        todo.append((cost + EDIT, child))
        return states


def vocabulary(paths: tuple[str, ...]) -> list[str]:
    """Words of public tokenizers' vocabularies (files of fixed size): their pieces of letters that begin a word, of all scripts."""
    words = set()
    for path in paths:
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip() and (piece := base64.b64decode(line.split()[0]))[:1] == b" ":
                    try:
                        word = piece[1:].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(word) > 1 and word.isalpha():
                        words.add(word)
    return sorted(words)


@lru_cache(maxsize=2)
def _trie(paths: tuple[str, ...]) -> Trie:
    return Trie(vocabulary(paths))


def default_vocabulary() -> tuple[str, ...]:
    """The paths of the vocabulary files of the public tokenizers. An error where they are not installed: without words doubtful letters stay apart, which the result would not show. To go by the table alone, give no paths as ``vocabulary_paths=()``."""
    try:
        import public_tokenizers
    except ImportError as e:
        raise RuntimeError("the vocabularies of public_tokenizers cannot be had; give the paths of others, or () to go by the table alone") from e
    return tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))


def _budget(token: str) -> int:
    """Doubtful letters that a token may have: a third of its letters, fewer than an edit costs, and none where fewer than two thirds are plain Latin."""
    return min(EDIT - 1, len(token) // 3) if 3 * sum(map(str.isascii, token)) >= 2 * len(token) else 0


class Speller:
    """Canonical spellings of tokens, kept for the tokens seen."""

    def __init__(self, paths: tuple[str, ...]) -> None:
        self.paths, self.known = paths, {}

    def word(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            hit = _trie(self.paths).match(token, _budget(token))
            self.known[token] = found = hit[1] if hit else respelled(skeleton(token))
        return found

    def text(self, text: str) -> str:
        """A text in its one form: words by trie or table, then spaces, signs and what cannot be seen by table."""
        if text.isascii():
            return text
        plain = TOKEN.sub(lambda m: self.word(m[0]), unicodedata.normalize("NFC", text))
        if plain.isascii():
            return plain
        return unicodedata.normalize("NFC", _SIGN.sub(lambda m: m[0].translate(_SIGNS), plain))


_SIGNS = {c: r for c, r in TABLE.items() if unicodedata.category(chr(c))[0] != "L" or not (r and r[0].isalpha())}


def _class(chars: set[str]) -> str:
    """The inside of a character class, neighbours as ranges."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs)


_READ = _class({chr(c) for c in TABLE if chr(c) not in map(chr, _SIGNS)} | set(DOUBTFUL) | {chr(c) for c, r in TABLE.items() if r == ""} | set(map(chr, range(0x300, 0x530))))
#: A run of letters, with their accents and what cannot be seen, that holds a character that may be read as another.
TOKEN = re.compile(rf"(?<![^\W\d_])[^\W\d_]*[{_READ}][^\W\d_]*(?:[{_READ}]+[^\W\d_]*)*")
_SIGN = re.compile("[" + _class({chr(c) for c in _SIGNS}) + "]+")

FORMS = "doc_id bigint, form string, form_id binary, text_id binary"


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def forms(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, vocabulary_paths: tuple[str, ...] | None = None) -> DataFrame:
    """Each document with the identities of its form and of its text, and its form where asked for.

    Null texts have a null form and identities. Rows are mapped one by one.
    """
    paths = default_vocabulary() if vocabulary_paths is None else vocabulary_paths
    fields = [("doc_id", pa.int64()), *([("form", pa.string())] if with_text else []), ("form_id", pa.binary()), ("text_id", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(paths)
        for b in batches:
            texts = b.column(1).to_pylist()
            form = [None if t is None else speller.text(t) for t in texts]
            ids = [None if f is None else _digest(f) for f in form]
            own = [i if f is t else None if t is None else _digest(t) for t, f, i in zip(texts, form, ids)]
            yield pa.RecordBatch.from_arrays([b.column(0), *([pa.array(form, pa.string())] if with_text else []), pa.array(ids, pa.binary()), pa.array(own, pa.binary())], schema=schema)

    src = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return spread(src).mapInArrow(run, ", ".join(f"{n} {'bigint' if n == 'doc_id' else 'string' if n == 'form' else 'binary'}" for n, _ in fields))


def twins(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = 8, vocabulary_paths: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first: texts that differ in code points but have one form.

    Pairs are formed between the distinct spellings of a form and then given
    their documents, so exact copies never meet each other. A spelling's
    documents are spread over ``salts`` tasks.
    """
    ids = cut(forms(docs, id_column, text_column, vocabulary_paths=vocabulary_paths).where("form_id IS NOT NULL"))
    spellings = ids.groupBy("form_id", "text_id").agg(F.lit(1).alias("one"))
    several = spellings.groupBy("form_id").agg(F.sum("one").alias("n")).where("n > 1").select("form_id")
    held = ids.join(several, "form_id", "left_semi")
    a = held.select("form_id", F.col("text_id").alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    pairs = a.join(b, "form_id").where("a < b").select("a", "b")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    each_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = held.select(F.col("text_id").alias("a"), F.col("doc_id").alias("x"), salt.alias("salt"))
    right = held.select(F.col("text_id").alias("b"), F.col("doc_id").alias("y"), salt.alias("salt"))
    met = left.join(pairs.withColumn("salt", each_salt), ["a", "salt"]).select("b", "x", each_salt.alias("salt"))
    found = met.join(right, ["b", "salt"])
    return found.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
