"""Free-entered values mapped to a canonical list.

Words of alphabetic scripts that are in no name but close to one are first read
as that word (``Words``: an index of shortened forms finds the candidates without
looking at the whole list). A multi-pattern automaton over canonical names, aliases and terms then
finds all embedded mentions; the longest that do not overlap win. What they
name together decides: of nested entries, such as accept and accept as poster,
the more specific. Values in which no mention decides go to the similarity of
token sets, over an inverted index of tokens. Nothing is shuffled but repeated
deliveries; the distinct values of a batch are mapped once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.dedupe import first_arrival
from scholia.session import spread

UNKNOWN = "unknown"

# Words in general use, in several languages, for the terms of which outcomes are made.
TERMS = {
    "accept": "accept accepts accepted accepting acceptance approve approved published publish; angenommen annahme; accepté acceptée acceptation; aceptado aceptada aceptación; accettato accettata; aceito; принято принята принять; 채택 수락 승인 합격 게재확정; 录用 接收 接受; 採録 採択 受理",
    "reject": "reject rejects rejected rejecting rejection decline declined declines refuse refused; abgelehnt ablehnung; rejeté rejetée rejet refusé refusée; rechazado rechazada rechazo; rifiutato; rejeitado; отклонено отклонена отказ; 거절 반려 탈락 불합격 게재불가; 拒稿 拒绝 退稿; 不採録 不採択",
    "oral": "oral orals talk; mündlich; orale; ponencia; устный; 구두 구술; 口头; 口頭",
    "spotlight": "spotlight spotlights; 스포트라이트; 亮点; スポットライト",
    "poster": "poster posters; póster; постер; 포스터; 海报; ポスター",
    "major": "major substantial; größere große; majeure majeures; mayor mayores; maggiore; существенная; 대폭 대규모; 大修; 大幅",
    "minor": "minor small; kleinere geringfügige; mineure mineures; menor menores; minore; незначительная; 소폭 경미한; 小修; 小幅",
    "revision": "revision revisions revise revised revising rev; überarbeitung revidieren; révision révisions réviser; revisión revisiones; revisione; revisão; доработка; 수정 보완; 修改 修订; 修正",
    "resubmit": "resubmit resubmits resubmitted resubmission resubmissions; wiedereinreichung; resoumettre; reenviar; 재투고 재제출; 重投 重新投稿; 再投稿",
    "desk": "desk editorial; 데스크 편집자; 案头 编辑部; デスク",
    "withdrawn": "withdrawn withdraw withdraws withdrew withdrawal withdrawing retracted retract; zurückgezogen; retiré retirée; retirado retirada; ritirato; отозвано отозвана; 철회 취하; 撤稿 撤回; 取り下げ",
}

# Phrases in general use and the terms that they name together; with "-" they name none and only keep their words from being taken for mentions.
PHRASES = {
    "reject": "not accepted, not accept, not be accepted, cannot accept, cannot be accepted, could not accept, unable to accept, do not accept, did not accept, nicht angenommen, non accepté, pas accepté, no aceptado, не принято, 불채택, 미채택, 채택 안 됨, 不录用, 不接收, 未录用",
    "-": "not rejected, not withdrawn, not a rejection, not desk rejected, to be accepted, if accepted, 거절 아님",
    "no binary decision": "no binary decision, no binary outcome, non binary decision, neither accepted nor rejected, neither accept nor reject, no accept or reject decision, no accept reject decision, no decision between accept and reject, 이분 결정 없음",
    "withdrawn": "pulled by the authors, withdrawn by the authors, taken back by the authors",
    "desk reject": "without review, without external review, not sent for review, not sent out for review",
}

# Words of running text that are never taken for a misspelt name.
RUNNING = set(
    "a an and any are as at be been but by can could did do for from get go had has have he her him his how i if in into is it its me my near new of on one or our out over per see she so than that the their them then there these they this to too up us was we were what when which who why will with would yes you your "
    "der die das und ist nicht mit von für le la les des est pas un une et el los del que es por il di da в на и не по с к".split()
)

# Words around a value that say nothing about it.
FILLER = {"final", "paper", "submission", "manuscript", "article", "outcome", "status", "result", "the", "a", "an", "was", "is", "as", "for", "of", "by", "this", "to", "with", "required", "needed", "requested", "recommended"}

#: A word with a year after it is a venue.
VENUE = re.compile(r"(?<![^\W_])[^\W\d_][^\W_]*[\s_]+(?:19|20|21)\d\d(?![^\W_])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_NEGATED = re.compile(r"(\w)n['’]t\b")


def fold(text: str) -> str:
    """One form for comparison: full width, case, camel case, signs, white space and venues with a year disregarded; accents kept."""
    text = VENUE.sub(" ", _NEGATED.sub(r"\1 not", unicodedata.normalize("NFKC", text)))
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFC", _CAMEL.sub(" ", text).casefold())))


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def tolerance(size: int) -> int:
    """How many edits a word of a size may be away from."""
    return 0 if size < 3 else 1 if size < 5 else 2


def _shortened(word: str, most: int) -> set[str]:
    """A word and what is left of it without up to ``most`` (0 to 2) of its letters."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Words:
    """Words by the hashes of what is left of them without a few letters: two words at most t edits apart share such a remainder."""

    def __init__(self, words: set[str], sure: set[str] = frozenset()) -> None:
        self.words, self.sure = words, sure
        self.listed = sorted(w for w in words if tolerance(len(w)))
        self.longest = max(map(len, self.listed), default=0)
        keys, owners = [], []
        for i, w in enumerate(self.listed):
            rests = [hash(r) for r in _shortened(w, tolerance(len(w)))]
            keys.append(np.array(rests, np.int64))
            owners.append(np.full(len(rests), i, np.int32))
        keys, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owners))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def near(self, token: str) -> str | None:
        """The word itself or the closest within its tolerance; ties to a sure word, then the first in order; None if there is none."""
        if token in self.words:
            return token
        if not 2 <= len(token) <= self.longest + 2 or not len(self.keys):
            return None
        rests = np.fromiter(map(hash, _shortened(token, min(2, len(token) - 1))), np.int64)
        lo, hi = np.searchsorted(self.keys, rests, "left"), np.searchsorted(self.keys, rests, "right")
        held = {int(i) for a, b in zip(lo, hi) if a < b for i in self.owners[a:b]}
        best = min(((d, w not in self.sure, w) for w in (self.listed[i] for i in held) if (d := edits(token, w, tolerance(len(w)))) <= tolerance(len(w))), default=None)
        return best[2] if best else None


def _wide(c: str) -> bool:
    return "⺀" <= c <= "鿿"


class Canon:
    """A canonical list, compiled once in each worker.

    ``entries`` gives the terms of each entry (an entry without a given set is a
    term of its own), ``patterns`` the terms that each spelling names. An entry
    is meant where all its terms are mentioned and no entry with more of them is.
    """

    def __init__(self, names: tuple[tuple[str, str], ...], terms: dict[str, str] = TERMS, phrases: dict[str, str] = PHRASES) -> None:
        known = {t for t in (*terms, "no", "binary", "decision")}
        self.entries: dict[str, frozenset[str]] = {}
        for entry, _ in names:
            parts = frozenset(entry.split("_"))
            self.entries[entry] = parts if parts <= known else frozenset([entry])
        self.whole = {p: e for e, p in self.entries.items()}
        #: Whether every entry is a term of its own.
        self.plain = all(len(p) == 1 for p in self.whole)
        self.patterns: dict[str, frozenset[str]] = {}
        used = frozenset().union(*self.entries.values()) if self.entries else frozenset()
        for term, words in terms.items():
            if term in used:
                for w in re.split(r"[;\s]+", words):
                    self._pattern(w, frozenset([term]))
        for entry, parts in self.entries.items():
            # The names of a way of accepting imply that it is one.
            if "accept" in parts:
                for term in parts - {"accept"}:
                    for w in re.split(r"[;\s]+", terms.get(term, "")):
                        self._pattern(w, parts)
        for meant, listed in phrases.items():
            parts = frozenset() if meant == "-" else frozenset(meant.split())
            if parts <= used:
                for phrase in listed.split(", "):
                    self._pattern(phrase, parts)
        for entry, name in names:
            for spelling in (name, entry):
                self._pattern(spelling, self.entries[entry])
        self.automaton = ahocorasick.Automaton()
        for pattern, parts in self.patterns.items():
            self.automaton.add_word(pattern.replace(" ", ""), (len(pattern.replace(" ", "")), parts))
        self.automaton.make_automaton()
        self.by_token: dict[str, list[int]] = {}
        self.sets: list[tuple[frozenset[str], str]] = []
        for pattern, parts in sorted(self.patterns.items()):
            own = self._entry(parts)
            if own != UNKNOWN:
                for token in (tokens := frozenset(pattern.split()) - FILLER):
                    self.by_token.setdefault(token, []).append(len(self.sets))
                self.sets.append((tokens, own))
        # Names of several words are also words without their blanks.
        spelled = {w for p in self.patterns for w in (*p.split(), p.replace(" ", "")) if w.isalpha() and max(w) < "ᄀ"}
        self.words = Words(spelled - RUNNING - FILLER, set(self.patterns))

    def _pattern(self, spelling: str, parts: frozenset[str]) -> None:
        if folded := fold(spelling):
            self.patterns[folded] = parts

    def _entry(self, terms: frozenset[str]) -> str:
        """The one entry all of whose terms are among the given ones and that no other such entry contains, else unknown."""
        own = self.whole.get(terms)
        if own is not None and self.plain:
            return own
        if self.plain:
            held = [e for t in terms if (e := self.whole.get(frozenset([t])))]
        else:
            covered = [e for e, p in self.entries.items() if p <= terms]
            held = [e for e in covered if not any(self.entries[e] < self.entries[o] for o in covered)]
        return held[0] if len(held) == 1 else UNKNOWN

    def mentions(self, text: str) -> list[tuple[int, int, frozenset[str]]]:
        """Mentions in a folded text, blanks disregarded: longest first chosen, none overlapping, in order.

        A mention begins and ends with words; in scripts that attach endings it
        only begins with one, in those without blanks it may stand anywhere.
        """
        squeezed = text.replace(" ", "")
        starts, ends, at = set(), set(), 0
        for word in text.split():
            starts.add(at)
            at += len(word)
            ends.add(at)
        held = []
        for last, (size, parts) in self.automaton.iter(squeezed):
            a, b = last - size + 1, last + 1
            c = squeezed[a]
            if (a in starts or _wide(c)) and (b in ends or "가" <= c <= "힣" or _wide(c)):
                held.append((a, b, parts))
        chosen: list[tuple[int, int, frozenset[str]]] = []
        taken: set[int] = set()
        for m in sorted(held, key=lambda m: (m[0] - m[1], m[0])):
            if m[0] not in taken and m[1] - 1 not in taken:
                chosen.append(m)
                taken.update(range(m[0], m[1]))
        return sorted(chosen, key=lambda m: m[:2])

    def similar(self, text: str, least: float) -> str:
        """The entry of the name whose token set is most similar (shared over all tokens), or unknown below ``least`` or at a tie of two entries."""
        tokens = {t for t in text.split() if t not in FILLER and not t.isdigit()}
        shared = Counter(i for t in tokens for i in self.by_token.get(t, ()))
        scores: dict[str, float] = {}
        for i, n in shared.items():
            own, entry = self.sets[i]
            scores[entry] = max(scores.get(entry, 0.0), n / (len(own) + len(tokens) - n))
        best = max(scores.values(), default=0.0)
        held = [e for e, s in scores.items() if s == best]
        return held[0] if best >= least and len(held) == 1 else UNKNOWN

    def decide(self, raw: str | None, least: float = 0.6) -> tuple[str, str]:
        """(entry or unknown, how it was found: mention, similarity or none)."""
        own = fold(raw or "").split()
        read = [t if t in RUNNING or t in FILLER or not t.isalpha() or max(t) >= "ᄀ" else self.words.near(t) or t for t in own]
        text = " ".join(read)
        if not text:
            return UNKNOWN, "none"
        several = False
        # Where misspelt words make it name several entries, those that are spelled right count.
        for told in dict.fromkeys((text, " ".join(own))):
            found = self.mentions(told)
            entry = self._entry(frozenset().union(*(m[2] for m in found))) if found else UNKNOWN
            if entry != UNKNOWN:
                return entry, "mention"
            several = several or sum(1 for m in found if self._entry(m[2]) != UNKNOWN) > 1
        if several:
            return UNKNOWN, "none"
        entry = self.similar(text, least)
        return entry, "none" if entry == UNKNOWN else "similarity"


@lru_cache(maxsize=4)
def _canon(names: tuple[tuple[str, str], ...]) -> Canon:
    return Canon(names)


def canonical(raw: Column, names: list[tuple[str, str]]) -> Column:
    """A struct of the canonical ``entry`` that free text means, or unknown, and the ``path`` on which it was found.

    Null and blank text give unknown. ``names`` are (entry, name) pairs of the
    canonical list, which each worker compiles once. Text that names several
    entries, or is equally similar to names of several, gives unknown.
    """
    key = tuple(sorted(names))

    @F.pandas_udf("entry string, path string")
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        canon = _canon(key)
        known: dict = {}
        for s in batches:
            if len(known) > 200_000:
                known.clear()
            for v in s.dropna().unique():
                if v not in known:
                    known[v] = canon.decide(v)
            rows = [known.get(v, (UNKNOWN, "none")) if v is not None and v == v else (UNKNOWN, "none") for v in s]
            yield pd.DataFrame(rows, columns=["entry", "path"])

    return mapped(raw)


def mapped_decisions(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(decision_id, outcome, path, outcome_raw) of each decision with a raw outcome that is not blank.

    Of repeated deliveries the first counts; rows without an id count as one
    key. ``outcomes`` is a list of fixed, small size and read by the driver.
    """
    names = [(r[0], n) for r in outcomes.select("outcome", "label", "label_ko").collect() for n in r[1:] if n]
    # Mapped where it is read, on all cores, and then reduced to first arrivals.
    told = spread(decisions.select("decision_id", "ingested_at", "outcome_raw")).withColumn("_found", canonical(F.col("outcome_raw"), names))
    told = told.select("decision_id", "ingested_at", "outcome_raw", F.col("_found.entry").alias("outcome"), F.col("_found.path").alias("path"))
    first = first_arrival(told, ["decision_id"], "ingested_at", ["outcome_raw", "outcome", "path"])
    return first.where(F.col("outcome_raw").rlike(r"(?U)\S")).select("decision_id", "outcome", "path", "outcome_raw")
