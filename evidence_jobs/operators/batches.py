"""Texts that are normalised and looked through a batch at a time."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_jobs.functions.text import normalize_name

#: Of ASCII: letters small, digits and _, which the word `ward` may touch, as they are; all else is a space.
SMALL = bytes(b if chr(b).islower() or chr(b).isdigit() or b == 95 else b + 32 if 65 <= b <= 90 else 32 for b in range(128)) + b" " * 128
#: spoken_ward_numbers of a normalised text, which has no dots, dashes and other white space.
SPOKEN = re.compile(r"\bward *(?:no|number)? *(\d{1,3})\b")


def text_columns(text: Column) -> dict[str, Column]:
    """What normalised_lines() reads of a text: `_raw`, the text if it is ASCII, with room for a line's ends, and else `_name`, the text normalised."""
    ascii = F.octet_length(text) == F.length(text)
    return {"_raw": F.concat(F.lit("  "), F.when(ascii, text).otherwise(""), F.lit(" ")), "_name": F.when(~ascii, normalize_name(text))}


def normalised_lines(raw: pa.Array, names: pa.Array) -> tuple[str, np.ndarray]:
    """normalize_name of all texts (text_columns) as lines, each after a line feed and between spaces, and the row of each line."""
    raw = raw.cast(pa.large_binary())
    starts = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(bytearray(bytes(memoryview(raw.buffers()[2])[starts[0] : starts[-1]]).translate(SMALL)), np.uint8)
    data[starts[:-1] - starts[0]] = 10
    data = data.tobytes()
    while b" ward " in data:
        data = data.replace(b" ward ", b" ")
    data = data.replace(b"_", b" ")
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    others = np.flatnonzero(names.is_valid().to_numpy(zero_copy_only=False))
    more = "".join(f"\n {names[int(i)].as_py()} " for i in others)
    return data.decode("ascii") + more, np.concatenate([np.arange(len(raw)), others])


def with_found(rows: DataFrame, finds: dict[str, tuple[dict[str, str], bool]], lookups: dict[str, list[tuple[str | None, dict[str, list[str]]]]], order: dict[str, list[str]], drop: tuple[str, ...]) -> DataFrame:
    """rows (text_columns) with an array column for each of finds, distinct values in the order given; without the columns to drop.

    finds: new column -> what phrases that stand in a text stand for, whether only whole
    words count. lookups: of a new column, (array column, table), what the table has for
    the items; without a column the items are the ward numbers spoken in the text. A batch
    is one text of many lines, so nothing of a row is done in Python but what it holds.
    All of finds and order are broadcast and must be dictionaries.
    """
    for target in finds:
        rows = rows.withColumn(target, F.array().cast("array<string>"))
    schema = rows.drop(*drop).schema
    known = rows.sparkSession.sparkContext.broadcast((finds, lookups, order))
    return rows.mapInArrow(_reader(known, schema.names), schema)


def _reader(known, kept: list[str]):
    def read(batches):
        finds, tables, order = known.value
        place = {t: {v: i for i, v in enumerate(order[t])} for t in finds}
        # A phrase with a line feed stands in no normalised text.
        made = {t: _automaton({p: place[t][v] for p, v in phrases.items() if "\n" not in p}, whole) for t, (phrases, whole) in finds.items()}
        codes = {t: [(c, {k: [place[t][v] for v in values] for k, values in table.items()}) for c, table in tables.get(t, ())] for t in finds}
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            lines, row_of = normalised_lines(columns["_raw"], columns["_name"])
            breaks = np.flatnonzero(np.frombuffer(lines.encode("ascii"), np.uint8) == 10)
            row_at = lambda at: row_of[np.searchsorted(breaks, at) - 1]  # noqa: B023, E731
            spoken = [(m.start(), m[1]) for m in SPOKEN.finditer(lines)] if "ward" in lines else []
            for target in finds:
                parts = []
                if made[target]:
                    hits = np.array(list(made[target].iter(lines)), np.int64).reshape(-1, 2)
                    parts.append((row_at(hits[:, 0]), hits[:, 1]))
                for name, table in codes[target]:
                    if name is None:
                        owners, items = row_at(np.array([at for at, _ in spoken], np.int64)), pa.array([n for _, n in spoken], pa.string())
                    else:
                        owners, items = np.repeat(np.arange(len(batch)), columns[name].value_lengths().to_numpy(zero_copy_only=False)), columns[name].flatten()
                    parts.append(_looked_up(owners, items, table))
                columns[target] = _lists(parts, len(batch), order[target])
            yield pa.RecordBatch.from_arrays([columns[c] for c in kept], kept)

    return read


def _automaton(phrases: dict[str, int], whole_words: bool) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        made.add_word(f" {phrase} " if whole_words else phrase, value)
    made.make_automaton()
    return made if phrases else None


def _looked_up(owners: np.ndarray, items: pa.Array, table: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of items that the table has; each distinct item is looked up once."""
    coded = items.dictionary_encode()
    values = [table.get(v, []) for v in coded.dictionary.to_pylist()] + [[]]  # the last is that of nulls
    at = coded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)
    sizes = np.array([len(v) for v in values])
    firsts, flat = np.cumsum(sizes) - sizes, np.array([x for v in values for x in v], np.int64)
    counts = sizes[at]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(owners, counts), flat[np.repeat(firsts[at], counts) + within]


def _lists(parts: list[tuple[np.ndarray, np.ndarray]], size: int, values: list[str]) -> pa.Array:
    """An array of distinct values for each of size rows, in the order of values."""
    wide = max(len(values), 1)
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(rows * wide + codes for rows, codes in parts)]))
    ends = np.cumsum(np.bincount(pairs // wide, minlength=size))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.string()).take(pa.array(pairs % wide)))


#: Between the values of fields, and before a text that is read as it is. A row that has either in its text goes the way of texts that aren't ASCII.
FIELD, START = "\x01", "\x00"
MARKED = SMALL[:1] + b"\x01" + SMALL[2:]
#: spoken_ward_numbers, of any length, of normalised texts and of small letters; they begin with letters, so that most of a text is skipped.
SPOKEN_NAME = re.compile(r"ward(?<![a-z0-9_]ward) *(?:no|number)? *(\d+)(?![a-z0-9_])")
SPOKEN_SMALL = re.compile(rb"ward(?<![a-z0-9_]ward)[ \t\n\x0b\f\r]*(?:no\.?|number)?[ \t\n\x0b\f\r]*-?[ \t\n\x0b\f\r]*(\d+)(?![a-z0-9_])")
WARD_NUMBER = re.compile(r"\b[0-9]{1,3}\b")
#: Classes that a task remembers at most.
MOST_SEEN = 1 << 20


def is_plain(text: Column) -> Column:
    """Whether a text is ASCII without the marks of batches."""
    return (F.octet_length(text) == F.length(text)) & ~text.contains(FIELD) & ~text.contains(START)


def match_texts(plain: Column) -> dict[str, Column]:
    """What with_matches() reads of a plain chunk: all of its text, its title and text, and its fields; nothing of others."""
    body, values = F.concat_ws(" ", "title", "text"), F.map_values("fields")
    marked = F.concat_ws(" ", "title", "text", F.lit(FIELD), F.array_join(values, f" {FIELD} "))
    return {
        "_raw": F.concat(F.lit("  "), F.when(plain, marked).otherwise(FIELD), F.lit(f" {FIELD} ")), "_body": F.concat(F.lit("  "), F.when(plain, body).otherwise(""), F.lit(" ")),
        "_keys": F.when(plain, F.map_keys("fields")), "_items": F.when(plain, values),
    }


def with_matches(rows: DataFrame, known: dict, lists: list[str], flags: list[str], also: list[str], drop: tuple[str, ...], by_class: bool) -> DataFrame:
    """rows (match_texts, and `_odd`, of others an array of what retrieval makes) with what each holds: an array column for each of lists, with their values in order, and a boolean for each of flags.

    known: `values`, the list of (column, value), and tables from what may be met to places in it: `whole`, `body` and `small` of phrases in the
    search text, in title and text normalised and in small letters, `field` of what a field's value is, `said` and `body_said` of ward numbers,
    `numbers` and `names` of ward numbers and names of fields, `fields` of the keys that hold a ward. All are broadcast.
    by_class adds _a and _b instead, 128 bits of a row's class, made of what it holds and of the columns `also`, `_issues`, those
    that it holds with commas, and in the first row of a class of a task `_told`, which told_columns() takes apart: a row
    costs the JVM more by its arrays than by all that is looked for.
    """
    made = {"_a": "long", "_b": "long", "_issues": "string", "_told": "string"} if by_class else {t: "boolean" if t in flags else "array<string>" for t in [*lists, *flags]}
    rows = rows.withColumns({name: F.lit(None).cast(kind) for name, kind in made.items()})
    schema = rows.drop(*drop).schema
    shared = rows.sparkSession.sparkContext.broadcast((known, lists, flags, also))
    return rows.mapInArrow(_matcher(shared, schema.names, by_class), schema)


def _weights(values: list) -> np.ndarray:
    """Two 64-bit numbers of each value."""
    digests = b"".join(hashlib.blake2b(repr(v).encode(), digest_size=16).digest() for v in values)
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


def _marked(raw: pa.Array, table: bytes | None, mark: int) -> tuple[bytes, np.ndarray]:
    """The texts as one, each after a mark; by a byte table or in small letters; and where they start."""
    raw = raw.cast(pa.large_binary())
    starts = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = bytes(memoryview(raw.buffers()[2])[starts[0] : starts[-1]])
    data = np.frombuffer(bytearray(data.translate(table) if table else data.lower()), np.uint8)
    data[starts[:-1] - starts[0]] = mark
    return data.tobytes(), starts[:-1] - starts[0]


def _without_ward(data: bytes) -> bytes:
    while b" ward " in data:
        data = data.replace(b" ward ", b" ")
    data = data.replace(b"_", b" ")
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def _spread(owners: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of the items at places of a table (sizes, firsts, values)."""
    sizes, firsts, flat = table
    counts = sizes[at]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(owners, counts), flat[np.repeat(firsts[at], counts) + within]


def _table(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in lists], np.int64)
    return sizes, np.cumsum(sizes) - sizes, np.array([x for v in lists for x in v], np.int64)


def _of_items(owners: np.ndarray, items: pa.Array, codes_of) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of items; each distinct one is asked for once."""
    coded = items.dictionary_encode()
    table = _table([*(codes_of(v) for v in coded.dictionary.to_pylist()), []])  # the last is that of nulls
    return _spread(owners, coded.indices.fill_null(len(table[0]) - 1).to_numpy(zero_copy_only=False), table)


def _owners(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _matcher(shared, kept: list[str], by_class: bool):
    def read(batches):
        known, lists, flags, also = shared.value
        values, wide = known["values"], max(len(known["values"]), 1)
        first_of, weights, seen = {}, _weights(values), np.zeros((0, 2), np.uint64)
        for i, (target, _) in enumerate(values):
            first_of.setdefault(target, i)
        sizes = {t: sum(v[0] == t for v in values) for t in first_of}
        targets = [*lists, *flags]
        plain_of = pa.array([v for _, v in values], pa.string())
        names_of = pa.array([chr(97 + targets.index(t)) + v if t in targets else "" for t, v in values], pa.string())
        made = {}
        for kind in ("whole", "body", "small", "field"):
            phrases = {p: codes for p, codes in known[kind].items() if p.strip(" \x01") and "\n" not in p and START not in p}
            if phrases:
                machine = ahocorasick.Automaton()
                for i, phrase in enumerate(phrases):
                    machine.add_word(phrase, i)
                machine.make_automaton()
                made[kind] = machine, _table(list(phrases.values()))
        said, body_said, numbers, names = known["said"], known["body_said"], known["numbers"], known["names"]
        both = lambda n: [*said.get(n, ()), *body_said.get(n, ())]
        spoken = lambda n: [*said.get(n, ()), *(numbers.get(n, ()) if len(n) <= 3 else ())]
        place = {}

        def named(value):
            word = " ".join(re.sub("[^a-z0-9]+", " ", re.sub(r"(?<![a-z0-9_])ward(?![a-z0-9_])", "", value.lower())).split())
            return [*names.get(word, ()), *names.get(word[:-1] if word.endswith("u") and len(word) > 4 else word, ())]

        def of_key(key):
            if key not in place:
                low = key.lower()
                place[key] = (low in known["fields"]) + 2 * ("ward" in low) + 4 * (key == "ward_name")
            return place[key]

        for batch in batches:
            columns, n, parts = dict(zip(batch.schema.names, batch.columns, strict=True)), len(batch), []
            others, odd = _owners(columns["_odd"]), columns["_odd"].flatten()
            row_of = np.concatenate([np.arange(n), others])

            def meet(kind, text, row_at):
                if kind in made:
                    machine, table = made[kind]
                    hits = np.fromiter(chain.from_iterable(machine.iter(text)), np.int64).reshape(-1, 2)
                    parts.append(_spread(row_at(hits[:, 0]), hits[:, 1], table))  # noqa: B023

            def lines(data, more):
                text = data.decode("ascii") + "".join(f"\n {v} " for v in odd.field(more).to_pylist())  # noqa: B023
                breaks = np.flatnonzero(np.frombuffer(text.encode("ascii"), np.uint8) == 10)
                return text, lambda at: row_of[np.searchsorted(breaks, at) - 1]  # noqa: B023

            data = _without_ward(_marked(columns["_raw"], MARKED, 10)[0])
            breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
            meet("field", data.decode("ascii"), lambda at: np.searchsorted(breaks, at) - 1)  # noqa: B023
            text, row_at = lines(data.replace(b"\x01 ", b""), "_name")
            meet("whole", text, row_at)
            if "ward" in text:
                found = [(m.start(), m[1]) for m in SPOKEN_NAME.finditer(text)]
                parts.append(_of_items(row_at(np.array([at for at, _ in found], np.int64)), pa.array([v for _, v in found], pa.string()), spoken))
            meet("body", *lines(_without_ward(_marked(columns["_body"], SMALL, 10)[0]), "_body_name"))
            small, starts = _marked(columns["_body"], None, 0)
            meet("small", small.decode("ascii"), lambda at: np.searchsorted(starts, at, "right") - 1)  # noqa: B023
            if b"ward" in small:
                found = [(m.start(), m[1].decode()) for m in SPOKEN_SMALL.finditer(small)]
                parts.append(_of_items(np.searchsorted(starts, np.array([at for at, _ in found], np.int64), "right") - 1, pa.array([v for _, v in found], pa.string()), lambda v: body_said.get(v, ())))
            for i, body in zip(others, odd.field("_body_small").to_pylist(), strict=True):
                meet("small", body, lambda at: np.full(len(at), i))  # noqa: B023
            of = lambda name, codes_of: parts.append(_of_items(others[_owners(odd.field(name))], odd.field(name).flatten(), codes_of))  # noqa: B023, E731
            of("_values", lambda v: known["field"].get(f"{FIELD} {v} {FIELD}", ()))
            of("_wards", both)
            of("_spoken", lambda v: said.get(v, ()))
            of("_body_spoken", lambda v: body_said.get(v, ()))
            if numbers or names:
                of("_said", lambda v: numbers.get(v, ()))
                of("_fields", lambda v: names.get(v, ()))
            kinds = columns["_keys"].flatten().dictionary_encode()
            kinds = np.array([of_key(k) for k in kinds.dictionary.to_pylist()] or [0])[kinds.indices.to_numpy(zero_copy_only=False)] if len(kinds) else np.zeros(0, int)
            owners, items = _owners(columns["_keys"]), columns["_items"].flatten()
            for bit, codes_of in (
                (1, lambda v: [*both(v.strip(" ")), *numbers.get(v.strip(" "), ())]), (2, lambda v: [c for w in WARD_NUMBER.findall(v) for c in numbers.get(w, ())]), (4, named),
            ):
                some = kinds & bit > 0
                if some.any():
                    parts.append(_of_items(owners[some], items.filter(pa.array(some)), codes_of))

            pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(r * wide + c for r, c in parts)]))
            rows, codes = pairs // wide, pairs % wide
            ends = np.cumsum(np.bincount(rows, minlength=n))
            if by_class:
                begins, totals = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.zeros((n, 2), np.uint64)
                totals += _sums(weights[codes] if len(codes) else np.zeros((0, 2), np.uint64), ends)
                for name in also:
                    column = columns[name]
                    nested = pa.types.is_list(column.type)
                    coded = (column.flatten() if nested else column).dictionary_encode()
                    own = np.concatenate([_weights([(name, v) for v in coded.dictionary.to_pylist()]), _weights([(name, None)])])
                    own = own[coded.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)]
                    totals += _sums(own, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))) if nested else own
                _, heads, of_head = np.unique(totals[:, 0], return_index=True, return_inverse=True)
                head = heads[of_head]
                same = (totals == totals[head]).all() and (ends - begins == (ends - begins)[head]).all()
                if not (same and (codes == codes[begins[head[rows]] + np.arange(len(codes)) - begins[rows]]).all()):
                    raise ValueError("two classes of chunks share 128 bits")
                at = np.minimum(np.searchsorted(seen[:, 0], totals[heads, 0]), max(len(seen) - 1, 0))
                old = (seen[at] == totals[heads]).all(axis=1) if len(seen) else np.zeros(len(heads), bool)
                chosen = np.sort(heads[~old])
                seen = np.concatenate([seen if len(seen) < MOST_SEEN else seen[:0], totals[chosen]])
                seen = seen[np.argsort(seen[:, 0])]
                columns["_a"], columns["_b"] = (pa.array(np.ascontiguousarray(totals[:, k]).view(np.int64)) for k in (0, 1))
                spot = np.full(n, -1)
                spot[chosen] = np.arange(len(chosen))
                mine = spot[rows] >= 0
                told = pc.binary_join(_rows_of(spot[rows[mine]], len(chosen), names_of.take(pa.array(codes[mine]))), FIELD)
                columns["_told"] = told.take(pa.array(spot, mask=spot < 0))
                mine = (codes >= first_of.get("issues", 0)) & (codes < first_of.get("issues", 0) + sizes.get("issues", 0))
                columns["_issues"] = pc.binary_join(_rows_of(rows[mine], n, plain_of.take(pa.array(codes[mine]))), ",")
            else:
                for target in [*lists, *flags]:
                    mine = (codes >= first_of.get(target, 0)) & (codes < first_of.get(target, 0) + sizes.get(target, 0))
                    columns[target] = pa.array(np.bincount(rows[mine], minlength=n) > 0) if target in flags else _rows_of(rows[mine], n, plain_of.take(pa.array(codes[mine])))
            yield pa.RecordBatch.from_arrays([columns[c] for c in kept], kept)

    return read


def told_columns(told: Column, lists: list[str], flags: list[str]) -> dict[str, Column]:
    """The arrays and flags of `_told`."""
    parts = F.split(told, FIELD)
    held = lambda mark: F.transform(F.filter(parts, lambda p: p.startswith(mark)), lambda p: p.substr(2, 1 << 30))
    return {t: held(chr(97 + i)) if t in lists else F.size(held(chr(97 + i))) > 0 for i, t in enumerate([*lists, *flags])}


def _rows_of(rows: np.ndarray, count: int, items: pa.Array) -> pa.Array:
    """An array for each of count rows, of items with their rows in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))]), pa.int32()), items)


def _sums(weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the weights that end at each of ends, row by row, modulo 2^64."""
    totals = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(weights, axis=0, dtype=np.uint64)])[ends]
    return totals - np.concatenate([np.zeros((1, 2), np.uint64), totals[:-1]])
