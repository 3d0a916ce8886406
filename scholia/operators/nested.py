"""Deeply nested records as related flat tables.

Every object, inner list, list member and whole record gets a Merkle identity:
the hash of its canonical form, computed bottom-up from the hashes of its
members. Objects that are equal are stored once (``objects``); each place where
one occurs is a row of ``bridge`` (parent, field, ordinal, child), and each
record a row of ``roots``. A path of field names is followed by joins over the
bridge, which gives back every occurrence with its ordinals; ``rebuilt`` puts a
record together again. What cannot be read is a row of ``faults``.

Records reach the shredder as JSON text of any depth: parsing, bringing the
shapes of several writers to one (``revision_document``) and hashing all keep
their own stack.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import cut, spread

NODES = "kind string, record_table string, root_id string, parent_id binary, field string, ordinal bigint, object_id binary, types string, scalars map<string,string>"

_MARK = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|\Z)')


def _stacked(text: str) -> Any:
    """JSON text of any depth as its value, without recursion; ValueError where it is not complete JSON."""
    held: list = []  # open containers; of an object also the key that waits for its value
    keys: list = []
    value, at, want = None, 0, "value"
    while True:
        m = _MARK.match(text, at)
        if not m:
            raise ValueError("no JSON")
        at, (sign, string, atom) = m.end(), m.groups()
        if want in ("value", "first value") and (sign in ("{", "[") if sign else string or atom):
            if sign:
                held.append({} if sign == "{" else [])
                keys.append(None)
                want = "first key" if sign == "{" else "first value"
                continue
            value = json.loads(string or atom)
        elif want in ("key", "first key") and string:
            keys[-1], want = json.loads(string), "colon"
            continue
        elif want == "colon" and sign == ":":
            want = "value"
            continue
        elif want == "next" and sign == ",":
            want = "key" if isinstance(held[-1], dict) else "value"
            continue
        elif sign and held and (sign == "}" and isinstance(held[-1], dict) and want in ("next", "first key") or sign == "]" and isinstance(held[-1], list) and want in ("next", "first value")):
            value = held.pop()
            keys.pop()
        elif want == "end" and not (sign or string or atom):
            return value
        else:
            raise ValueError("no JSON")
        if not held:
            want = "end"
        elif isinstance(held[-1], dict):
            held[-1][keys[-1]], want = value, "next"
        else:
            held[-1].append(value)
            want = "next"


def parsed(text: str) -> Any:
    """The value of JSON text, a byte order mark before it left out; ValueError where it is not complete JSON."""
    text = text.lstrip("\ufeff")
    try:
        return json.loads(text)
    except RecursionError:
        return _stacked(text)


def decoded(value: Any) -> Any:
    """A value that was delivered as JSON text, as its structure, however often it was wrapped; other text stays."""
    while isinstance(value, str) and value.lstrip("\ufeff \t\r\n")[:1] in ("{", "[", '"'):
        try:
            value = parsed(value)
        except ValueError:
            break
    return value


def members(value: Any) -> list:
    """A list as it is, a lone value as a list of one, nothing as an empty list."""
    value = decoded(value)
    return value if isinstance(value, list) else [] if value is None else [value]


def _card(card: Any, card_id: Any = None) -> Any:
    card = decoded(card)
    if not isinstance(card, dict):
        return None
    card = dict(card)
    if card.get("card_id") is None and card_id is not None:
        card["card_id"] = card_id
    card["edits"] = [decoded(x) for x in members(card.get("edits"))]
    precedents = decoded(card.get("precedents"))
    if isinstance(precedents, list):
        precedents = {"items": precedents}
    if isinstance(precedents, dict):
        # A lone precedent may stand where its holder is expected.
        items = precedents if "items" not in precedents and "work_id" in precedents else precedents.get("items")
        precedents = dict(precedents if items is not precedents else {}, items=[decoded(x) for x in members(items)])
    card["precedents"] = precedents if isinstance(precedents, dict) else None
    return card


def _is_card(value: dict) -> bool:
    return any(k in value for k in ("card_id", "edits", "precedents"))


def _cards(value: Any) -> list:
    """The card revisions of a payload, whatever it is wrapped in, in their order."""
    out, stack = [], [value]
    while stack:
        value = decoded(stack.pop())
        if isinstance(value, list):
            stack.extend(reversed(value))
        elif isinstance(value, dict) and "revisions" in value:
            held = decoded(value["revisions"])
            if isinstance(held, dict) and not _is_card(held):
                out.extend(_card(x, k) for k, v in held.items() for x in members(v))
            else:
                out.extend(_card(x) for x in members(held))
        elif isinstance(value, dict) and _is_card(value):
            out.append(_card(value))
        elif isinstance(value, dict):
            stack.extend(x for v in reversed(value.values()) if isinstance(x := decoded(v), dict | list))
    return out


def revision_document(text: str) -> dict:
    """A payload in one shape, {"revisions": [card revision, ...]}, beside the payload as it was sent.

    Understood are: a byte order mark, JSON text inside JSON text, a list of
    payloads, any wrapping objects, card revisions as a list, as a map by card id
    or alone, and lists, lone objects or JSON text for edits, precedents and
    their items. What both have in common is stored once, as all equal objects.
    Text that is not complete JSON raises ValueError.
    """
    payload = parsed(text)
    return {"revisions": [c for c in _cards(payload) if c is not None], "payload": payload}


def plain_document(text: str) -> Any:
    return parsed(text)


def _text(value: Any) -> str:
    """A scalar as text, other than text as JSON has it."""
    kind = type(value)
    return value if kind is str else int.__repr__(value) if kind is int else json.dumps(value)


_CONTAINERS = (dict, list)
_TYPES = {str: "s", int: "n", float: "n", bool: "b", type(None): "0"}


def _digest(kind: bytes, parts: list[bytes]) -> bytes:
    return blake2b(kind + b"\0".join(parts), digest_size=16).digest()


class Shredder:
    """Merkle identities and rows of one batch; what was seen in the batch gives its rows once."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.seen: set[bytes] = set()
        self.scalars: dict[tuple, bytes] = {}
        self.names: dict[str, bytes] = {}

    def scalar(self, value: Any) -> bytes:
        key = (type(value), value)
        own = self.scalars.get(key)
        if own is None:
            own = self.scalars[key] = _digest(_TYPES[key[0]].encode(), [_text(value).encode("utf-8", "surrogatepass")])
        return own

    def stored(self, own: bytes, types: str, scalars: list) -> bool:
        """Whether an identity is new; its row is then added."""
        if own in self.seen:
            return False
        self.seen.add(own)
        self.rows.append(("object", None, None, None, None, None, own, types, scalars))
        return True

    def identity(self, value: Any) -> bytes:
        """The identity of a value; rows for all that it holds are added on the way.

        Containers are listed parents first and hashed in the opposite order, so
        all members of one have their identity before it.
        """
        if not isinstance(value, _CONTAINERS):
            return self.scalar(value)
        order = [value]
        for v in order:
            for x in v.values() if isinstance(v, dict) else v:
                if isinstance(x, _CONTAINERS):
                    order.append(x)
        done: dict[int, bytes] = {}
        for v in reversed(order):
            if id(v) not in done:
                done[id(v)] = self._object(v, done) if isinstance(v, dict) else self._list(v, done)
        return done[id(value)]

    def _ids(self, items: list, done: dict[int, bytes]) -> list[bytes]:
        return [done[id(x)] if isinstance(x, _CONTAINERS) else self.scalar(x) for x in items]

    def _edges(self, parent: bytes, field: str, items: list, ids: list[bytes]) -> None:
        for at, (own, x) in enumerate(zip(ids, items), 1):
            self.rows.append(("edge", None, None, parent, field, at, own, None, None))
            if not isinstance(x, _CONTAINERS):
                self.stored(own, "=" + _TYPES[type(x)], [("", None if x is None else _text(x))])

    def _list(self, items: list, done: dict[int, bytes]) -> bytes:
        return _digest(b"l", self._ids(items, done))

    def _object(self, value: dict, done: dict[int, bytes]) -> bytes:
        parts, types, scalars = [], [], []
        for k in sorted(value):
            v = value[k]
            if isinstance(v, _CONTAINERS):
                own = done[id(v)]
                if not isinstance(v, dict) and not v:
                    types.append("l")
                    scalars.append((k, None))
            else:
                own = self.scalar(v)
                types.append(_TYPES[type(v)])
                scalars.append((k, None if v is None else _text(v)))
            name = self.names.get(k)
            if name is None:
                name = k.encode("utf-8", "surrogatepass")
                name = self.names[k] = b"%d:%s" % (len(name), name)
            parts += (name, own)
        own = _digest(b"o", parts)
        if self.stored(own, "".join(types), scalars):
            for k, v in value.items():
                if isinstance(v, dict):
                    self.rows.append(("edge", None, None, own, k, 0, done[id(v)], None, None))
                elif isinstance(v, list):
                    self._edges(own, k, v, self._ids(v, done))
                    self._inner(v, done)
        return own

    def _inner(self, items: list, done: dict[int, bytes]) -> None:
        """Lists inside a list are objects of their own, with their members under the empty field."""
        todo = [x for x in items if isinstance(x, list)]
        for x in todo:
            if self.stored(done[id(x)], "L", []):
                self._edges(done[id(x)], "", x, self._ids(x, done))
                todo += [y for y in x if isinstance(y, list)]


_ARROW = pa.schema([("kind", pa.string()), ("record_table", pa.string()), ("root_id", pa.string()), ("parent_id", pa.binary()), ("field", pa.string()), ("ordinal", pa.int64()), ("object_id", pa.binary()), ("types", pa.string()), ("scalars", pa.map_(pa.string(), pa.string()))])


def _safe(text: str | None) -> str | None:
    """Text that can be stored: a lone surrogate, which UTF-8 has no form for, as its escape."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def shred(records: DataFrame, document: Callable[[str], Any]) -> DataFrame:
    """``records`` (record_table, root_id, doc: JSON text) as rows of ``NODES``.

    kind is root (object_id is the record's identity), edge (parent_id, field,
    ordinal from 1 in a list with null members counted, 0 for a lone object,
    object_id the child), object (its own scalar fields as text in ``scalars``
    and one sign each in ``types``: s text, n number, b truth value, 0 null, l an
    empty list; L alone: an inner list; a list member that is no object has its
    value under the empty name and = before its sign) or fault (a doc that is null or not complete JSON). All
    fields of all records give rows. Rows are distinct within a batch only:
    ``flat_tables`` makes them so overall.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Shredder()
            for record_table, root_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if text is None:
                        raise ValueError("no text")
                    doc = document(text)
                except ValueError:
                    s.rows.append(("fault", record_table, root_id, None, None, None, None, None, None))
                    continue
                s.rows.append(("root", record_table, root_id, None, None, None, s.identity(doc), None, None))
            columns = list(zip(*s.rows)) or [()] * len(_ARROW)
            columns[4] = [_safe(f) for f in columns[4]]
            columns[8] = [None if m is None else [(_safe(k), _safe(v)) for k, v in m] for m in columns[8]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)

    return spread(records.select("record_table", "root_id", "doc")).mapInArrow(run, NODES)


def flat_tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """roots, bridge and objects out of shredded rows, each row once."""
    roots = nodes.where("kind = 'root'").select("record_table", "root_id", "object_id").distinct()
    bridge = nodes.where("kind = 'edge'").select("parent_id", "field", "ordinal", F.col("object_id").alias("child_id")).distinct()
    objects = nodes.where("kind = 'object'").groupBy("object_id").agg(F.first("types").alias("types"), F.first("scalars").alias("scalars"))
    return roots, bridge, objects


def faults(nodes: DataFrame) -> DataFrame:
    """(record_table, root_id) of the records that could not be read."""
    return nodes.where("kind = 'fault'").select("record_table", "root_id").distinct()


def rebuilt(object_id: bytes, edges: dict[bytes, list], objects: dict[bytes, tuple]) -> Any:
    """A record out of its rows, for exports and tests of single records: ``edges`` are (field, ordinal, child) by parent, ``objects`` (types, scalars) by identity."""
    done: dict[bytes, Any] = {}
    todo = [object_id]
    while todo:
        own = todo[-1]
        if own in done:
            todo.pop()
            continue
        mine = sorted(edges.get(own, ()))
        missing = [c for _, _, c in mine if c not in done]
        if missing:
            todo += missing
            continue
        types, scalars = objects[own]
        read = {} if types[:1] == "=" else {k: [] if t == "l" else None if t == "0" else v if t == "s" else json.loads(v) for t, (k, v) in zip(types, sorted(scalars.items()))}
        if types == "L":
            done[own] = [done[c] for _, _, c in mine]
        elif types[:1] == "=":
            (text,) = scalars.values()
            done[own] = None if types == "=0" else text if types == "=s" else json.loads(text)
        else:
            for field, ordinal, child in mine:
                if ordinal:
                    read.setdefault(field, []).append(done[child])
                else:
                    read[field] = done[child]
            done[own] = read
        todo.pop()
    return done[object_id]


def follow(at: DataFrame, bridge: DataFrame, field: str, ordinal: str | None = None) -> DataFrame:
    """``at`` (with object_id) one step down: a row for each member of ``field``, its place in ``ordinal``."""
    step = bridge.where(F.col("field") == field).select(F.col("parent_id").alias("object_id"), F.col("child_id").alias("_child"), *([F.col("ordinal").alias(ordinal)] if ordinal else []))
    return at.join(step, "object_id").drop("object_id").withColumnRenamed("_child", "object_id")


def attribute(at: DataFrame, objects: DataFrame, name: str, to: str) -> DataFrame:
    """``at`` with the scalar ``name`` of its object; rows whose object has none keep a null."""
    own = objects.select("object_id", F.col("scalars")[name].alias(to)).where(F.col(to).isNotNull())
    return at.join(own, "object_id", "left")


def revision_records(revision: DataFrame, raw: DataFrame) -> DataFrame:
    """Stored revisions and raw payloads as JSON text of one kind."""
    whole = F.to_json(F.struct(*[c for c in revision.columns if c != "ingested_at"]), {"ignoreNullFields": "false"})
    stored = revision.select(F.lit("revision").alias("record_table"), F.col("revision_id").alias("root_id"), F.concat(F.lit('{"revisions":['), whole, F.lit("]}")).alias("doc"))
    return stored.unionByName(raw.select(F.lit("revision_raw").alias("record_table"), F.col("raw_id").alias("root_id"), F.col("payload").alias("doc")))


def card_records(cards: DataFrame) -> DataFrame:
    whole = F.to_json(F.struct(*[c for c in cards.columns if c != "ingested_at"]), {"ignoreNullFields": "false"})
    return cards.select(F.lit("risk_cards").alias("record_table"), F.col("card_id").alias("root_id"), whole.alias("doc"))


def record_nodes(revision: DataFrame, raw: DataFrame, cards: DataFrame) -> DataFrame:
    """All nested records of the three tables, shredded with all their fields and kept."""
    return cut(shred(revision_records(revision, raw), revision_document).unionByName(shred(card_records(cards), plain_document)))


def found(revision: DataFrame, raw: DataFrame, cards: DataFrame) -> DataFrame:
    """Each edit id, precedent work and plan line with its record, card and place.

    Columns as p3_found in TESTDATA.md. Members that are null or have no value
    give no row but are counted in ``pos``; repeated deliveries give one row.
    """
    roots, bridge, objects = flat_tables(record_nodes(revision, raw, cards))
    revised = attribute(follow(roots.where("record_table <> 'risk_cards'"), bridge, "revisions"), objects, "card_id", "card_id")
    edits = attribute(follow(revised, bridge, "edits", "pos"), objects, "edit_id", "val")
    items = attribute(follow(follow(revised, bridge, "precedents"), bridge, "items", "pos"), objects, "work_id", "val")
    lines = attribute(follow(follow(roots.where("record_table = 'risk_cards'"), bridge, "why_applies"), bridge, "plan_lines", "pos"), objects, "", "val").withColumn("card_id", F.col("root_id"))
    parts = [df.select(F.lit(name).alias("relation"), "root_id", "card_id", "pos", "val") for name, df in (("edits", edits), ("precedent_items", items), ("plan_lines", lines))]
    return reduce(DataFrame.unionByName, parts).where("val IS NOT NULL").distinct()
