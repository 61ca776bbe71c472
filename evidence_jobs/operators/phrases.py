"""Many phrases met in many texts in one pass."""

from __future__ import annotations

from itertools import zip_longest

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases in one automaton, at most; a larger dictionary is met shard by shard.
SHARD_BYTES = 16 << 20


def shards(phrases: DataFrame, most_bytes: int = SHARD_BYTES):
    """Lists of the distinct, non-empty phrases (one column), each of about most_bytes; one is on the driver at a time."""
    name = phrases.columns[0]
    distinct = phrases.where(F.coalesce(F.col(name), F.lit("")) != "").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length(name) + 16), F.lit(0))).first()[0]
    count = max(1, -(-size // most_bytes))
    for i in range(count):
        part = distinct if count == 1 else distinct.where(F.pmod(F.xxhash64(name), F.lit(count)) == i)
        yield [r[0] for r in part.collect()]


def automaton(phrases: list[str], whole_words: bool) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in phrases:
        made.add_word(f" {phrase} " if whole_words else phrase, phrase)
    made.make_automaton()
    return made


def with_phrases(rows: DataFrame, finds: dict[str, tuple], most_bytes: int = SHARD_BYTES, lookups: dict[str, list[tuple[str, dict[str, list[str]]]]] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with an array column for each of finds: the distinct phrases that stand in a text, sorted; without the columns to drop.

    finds: new column -> (text column, phrases, whether only whole words count) and, if
    given, array columns whose items count too where they are phrases; the text column may
    then be None. lookups: of a new column, (array column, table), what the table has
    for the items. Words are parted by single spaces, as normalised texts have them. All
    phrases of a shard are looked for at once by an automaton, which is broadcast as a
    plain list and made by each task; no row meets a phrase that it does not hold. A null
    text holds none.
    """
    out, lookups = rows.withColumns({target: F.array().cast("array<string>") for target in finds}), lookups or {}
    shards_of = zip_longest(*(shards(find[1], most_bytes) for find in finds.values()))
    parts = next(shards_of, None)
    while parts is not None:
        after = next(shards_of, None)  # the last pass leaves out what is to be dropped
        lists = {target: words for target, words in zip(finds, parts, strict=True) if words}
        if lists or lookups:
            known = rows.sparkSession.sparkContext.broadcast((lists, lookups))
            texts = {t: (find[0], find[2], list(find[3]) if len(find) > 3 else []) for t, find in finds.items() if t in lists or t in lookups}
            schema = out.schema if after else out.drop(*drop).schema
            out = out.mapInArrow(_finder(known, texts, schema.names), schema)
        parts, lookups = after, {}
    return out.drop(*drop)


def _finder(known, texts: dict[str, tuple[str | None, bool, list[str]]], kept: list[str]):
    def find(batches):
        lists, tables = known.value
        made = {t: automaton(lists[t], whole) for t, (source, whole, _) in texts.items() if source and t in lists}
        members = {t: frozenset(lists[t]) for t, (_, _, also) in texts.items() if also and t in lists}
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            read: dict[str, list] = {}
            values = lambda name: read[name] if name in read else read.setdefault(name, columns[name].to_pylist())  # noqa: B023, E731
            for target, (source, whole, also) in texts.items():
                pad = " " if whole else ""
                found = [set(before) for before in columns[target].to_pylist()]
                if target in made:
                    meet = made[target].iter
                    for held, text in zip(found, values(source), strict=True):
                        if text is not None:
                            held.update(p for _, p in meet(f"{pad}{text}{pad}"))
                if target in members:
                    for name in also:
                        for held, items in zip(found, values(name), strict=True):
                            held.update(x for x in items or () if x in members[target])
                for name, table in tables.get(target, ()):
                    for held, items in zip(found, values(name), strict=True):
                        for x in items or ():
                            held.update(table.get(x, ()))
                columns[target] = pa.array([sorted(held) for held in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([columns[c] for c in kept], kept)

    return find
