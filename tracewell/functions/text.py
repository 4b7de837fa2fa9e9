"""Text functions: tokens, stems, lemma expansion, slugs."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .lemmas import LEMMAS

TOKEN = r"[\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """The stems of each array of lower-case words, in their places. Each distinct word of a batch is stemmed once."""
    import pyarrow as pa

    from tracewell.functions.stem import stem

    flat = words.flatten().dictionary_encode()
    known = pa.array([None if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    sizes = pa.compute.fill_null(pa.compute.list_value_length(words), 0)
    ends = pa.compute.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int32()), sizes.cast(pa.int32())]))
    return pa.ListArray.from_arrays(ends, known.take(flat.indices))


def counted(terms: list[str], stemmed: bool = True):
    """A function of arrays of words: how often each of `terms` is among them (as stems), and under null how many other words there are."""

    @F.arrow_udf("array<struct<term:string,n:bigint>>")
    def count(words: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        from tracewell.functions.stem import stem

        place = {t: i for i, t in enumerate(terms)}
        flat = words.flatten().dictionary_encode()
        known = np.array([place.get(stem(w) if stemmed else w, -1) for w in flat.dictionary.to_pylist()] + [-1], np.int64)
        code = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        hit = code >= 0
        distinct, times = np.unique(row[hit] * max(1, len(terms)) + code[hit], return_counts=True)
        rows, which = np.divmod(distinct, max(1, len(terms)))
        order = np.argsort(np.concatenate([rows, np.arange(len(sizes))]), kind="stable")
        which = np.concatenate([which, np.full(len(sizes), -1)])[order]
        n = np.concatenate([times, sizes - np.bincount(row[hit], minlength=len(sizes))])[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sizes)) + 1)])
        names = pa.array(terms, pa.string()).take(pa.array(which, mask=which < 0))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([names, pa.array(n, pa.int64())], ["term", "n"]))

    return count


def stem_set(text: Column) -> Column:
    """Distinct stems of a text's tokens and of their irregular base forms."""
    return F.array_distinct(stems(query_terms(text)))


def lemma(word: Column) -> Column:
    """Base form of an irregular form; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LEMMAS.items() for x in pair])
    return table[word]


def query_terms(text: Column) -> Column:
    """Distinct tokens in order, each followed by its irregular base form."""
    found = F.transform(tokens(text), lambda t: F.array_compact(F.array(t, lemma(t))))
    return F.array_distinct(F.flatten(found))


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens; `skill` if nothing is left."""
    plain = F.trim(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "-")), F.lit("-"))
    return F.when(plain == "", "skill").otherwise(plain)
