"""A matter's dictionary from YAML: what is always masked, and what never is. Such a file is written by hand and small."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: The file's keys and the type of entries that name none. Fixed values.
MATTER, MASK, NEVER, VALUE, TYPE, VARIANTS, HIDDEN = "dosya", "maskele", "maskeleme", "deger", "tur", "varyantlar", "GİZLİ"


@dataclass
class Dictionary:
    """entries: (phrase, label type), a value and each of its variants alike; allowed: phrases that stay."""

    matter: str = ""
    entries: list[tuple[str, str]] = field(default_factory=list)
    allowed: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(phrase, label_type), for `filters.dictionary_join`."""
        return spark.createDataFrame(self.entries, "phrase string, label_type string")


def read_dictionary(text: str) -> Dictionary:
    """The dictionary in a YAML text; an empty text is an empty dictionary, an entry without a value a ValueError."""
    import yaml

    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError("a dictionary is a mapping")
    out = Dictionary(str(data.get(MATTER) or ""), allowed=[str(p) for p in data.get(NEVER) or []])
    for entry in data.get(MASK) or []:
        given = entry if isinstance(entry, dict) else {VALUE: entry}
        if given.get(VALUE) is None:
            raise ValueError(f"an entry without {VALUE!r}: {entry!r}")
        label_type = str(given.get(TYPE) or HIDDEN).upper().replace(" ", "_")
        out.entries += [(str(phrase), label_type) for phrase in [given[VALUE], *(given.get(VARIANTS) or [])]]
    return out
