"""The egress gate: known values do not leave, in any of the spellings that docveil.operators.egress knows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.operators.batches import mapped
from docveil.operators.egress import Scanner, beginnings, cleaned, forms_of, keys_of, met
from docveil.operators.staging import kept

#: Values of up to so many forms are sent to all tasks, each scanning a text for all of its matter's at once.
SENT = 100_000
#: Of more, a text meets those whose letters and digits it has; what no value begins with, or is, is known by bits in an array of
#: this size.
BITS = 1 << 25


def name_forms(label_type: str, value: str) -> list[str]:
    """A person's value, first with last name, the last name, and initials with the last name."""
    words = value.split()
    if label_type != "KISI" or len(words) < 2:
        return [value]
    initials = " ".join(f"{w[0]}." for w in words[:-1])
    return list(dict.fromkeys([value, f"{words[0]} {words[-1]}", f"{words[0][0]}. {words[-1]}", f"{initials} {words[-1]}", words[-1]]))


def value_forms(values: DataFrame) -> DataFrame:
    """(matter_id, form, label_type, label) of values (matter_id, label_type, label, value): each value and, of names, their
    parts; a part that several labels of a matter share, or that is another value, stands for none of them."""
    matter = values.schema["matter_id"].dataType.simpleString()
    rows = values.where("matter_id is not null and value is not null").select("matter_id", "label_type", "label", "value").distinct()

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(m, f, t, n, f == v) for m, t, n, v in frame.itertuples(index=False) for f in name_forms(t, v) if forms_of(t, f)]
            yield pd.DataFrame(found, columns=["matter_id", "form", "label_type", "label", "own"])

    every = rows.mapInPandas(forms, f"matter_id {matter}, form string, label_type string, label string, own boolean")
    every = every.groupBy("matter_id", "form", "label_type", "label").agg(F.max("own").alias("own"))
    shared = every.where("label_type = 'KISI'").groupBy("matter_id", "form").agg(F.count_distinct("label").alias("owners")).where("owners > 1").select("matter_id", "form", F.lit(True).alias("shared"))
    return every.join(shared, ["matter_id", "form"], "left").where("shared is null or own").drop("shared", "own")


def _rows(out_id: object, text: str, found: list[tuple[int, int, str, str]]) -> list[tuple]:
    hits: dict[tuple[str, str], int] = {}
    for _, _, label_type, label in found:
        hits[label_type, label] = hits.get((label_type, label), 0) + 1
    return [(out_id, t, n, k, cleaned(text, found) if i == 0 else None) for i, ((t, n), k) in enumerate(sorted(hits.items()))]


def gate(outgoing: DataFrame, values: DataFrame, sent: int = SENT) -> DataFrame:
    """(out_id, label_type, label, hits, cleaned): vault values (matter_id, label_type, label, value) that outgoing texts
    (out_id, matter_id, text) still show, and the text with labels instead; cleaned is null on all but a text's first row.
    Longer values are looked for first, single words only where the text has a capital, and nothing within labels.

    Up to `sent` forms of values go to all tasks. More of them meet texts by their letters and digits (see near_values), with the
    same result.
    """
    return gate_by_forms(outgoing, kept(value_forms(values), "forms"), sent)


def gate_by_forms(outgoing: DataFrame, forms: DataFrame, sent: int = SENT) -> DataFrame:
    """gate for forms that value_forms gave, read from a table."""
    rows = outgoing.where("matter_id is not null and text is not null").select("out_id", "matter_id", "text")
    schema = f"out_id {outgoing.schema['out_id'].dataType.simpleString()}, label_type string, label string, hits bigint, cleaned string"
    if forms.count() <= sent:
        by_matter: dict[object, list[tuple[str, str, str]]] = {}
        for r in forms.collect():
            by_matter.setdefault(r["matter_id"], []).append((r["form"], r["label_type"], r["label"]))
        shared = outgoing.sparkSession.sparkContext.broadcast(by_matter)

        # a task's own, from one batch to the next
        scanners: dict[object, Scanner] = {}

        def run(ids: list, matters: list, texts: list) -> Iterator[tuple]:
            for out_id, matter, text in zip(ids, matters, texts):
                if matter in shared.value:
                    if matter not in scanners:
                        scanners[matter] = Scanner(shared.value[matter])
                    yield from _rows(out_id, text, scanners[matter].scan(text))

        return mapped(rows, run, schema)
    # short texts lie in few files, and much is done with each
    rows = rows.repartition(_tasks(rows), "out_id").withColumn("digest", F.sha2("text", 256))

    def few(ids: list, texts: list, values: list) -> Iterator[tuple]:
        for out_id, text, near in zip(ids, texts, values):
            yield from _rows(out_id, text, Scanner((v["form"], v["label_type"], v["label"]) for v in near).scan(text))

    return mapped(rows.join(near_values(rows, forms), ["matter_id", "digest"]).select("out_id", "text", "near"), few, schema)


def _tasks(rows: DataFrame, each: int = 50_000) -> int:
    return -(-rows.count() // each) or 1


def _bits(matter: object, keys: Iterable[str], kind: str) -> np.ndarray:
    head = f"{matter}{kind}"
    return np.array([xxhash.xxh3_64_intdigest((head + k).encode("utf-8", "surrogatepass")) % BITS for k in keys], np.int64)


#: What a bit stands for: a whole key, or one of its beginnings.
WHOLE, BEGUN = "\0", "\1"


def near_values(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """(matter_id, digest, near): for each text (matter_id, digest, text), the forms whose letters and digits it has one after
    another, whatever stands between. Values that only begin alike are not sent to a text."""
    matter = rows.schema["matter_id"].dataType.simpleString()

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(m, k, f, t, n) for m, f, t, n in frame.itertuples(index=False) for k in keys_of(t, f)]
            yield pd.DataFrame(found, columns=["matter_id", "key", "form", "label_type", "label"])

    keys = kept(forms.select("matter_id", "form", "label_type", "label").mapInPandas(keyed, f"matter_id {matter}, key string, form string, label_type string, label string"), "keys")

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"bit": np.concatenate([np.zeros(0, np.int64), *(b for m, k in zip(frame["matter_id"], frame["key"]) for b in (_bits(m, [k], WHOLE), _bits(m, beginnings(k), BEGUN)))])})

    # a bit array of fixed size, however many values there are
    bits = keys.select("matter_id", "key").mapInPandas(marked, "bit bigint").selectExpr("cast(bit >> 6 as int) as block", "1L << cast(bit & 63 as int) as bits")
    got = bits.groupBy("block").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    seen = np.zeros(BITS >> 6, np.uint64)
    seen[got["block"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(seen)
    lengths = sorted(r["n"] for r in keys.select(F.length("key").alias("n")).distinct().collect())

    def told(matter: object, kind: str, keys: list[str]) -> np.ndarray:
        bit = _bits(matter, keys, kind)
        return (shared.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def meet(matters: list, digests: list, texts: list) -> Iterator[tuple]:
        for m, digest, text in zip(matters, digests, texts):
            for k in met(text, lengths, lambda x: told(m, BEGUN, x), lambda x: told(m, WHOLE, x)):
                yield m, digest, k

    texts = mapped(rows.select("matter_id", "digest", "text"), meet, f"matter_id {matter}, digest string, key string")
    return texts.join(keys, ["matter_id", "key"]).groupBy("matter_id", "digest").agg(F.collect_set(F.struct("form", "label_type", "label")).alias("near"))


def leak_audit(log: DataFrame, values: DataFrame) -> DataFrame:
    """(source, label_type, label, hits, texts) over a log of outgoing texts (out_id, matter_id, source, text)."""
    found = gate(log, values).join(log.select("out_id", "source"), "out_id")
    return found.groupBy("source", "label_type", "label").agg(F.sum("hits").alias("hits"), F.count_distinct("out_id").alias("texts"))
