"""Blocks of texts beside the rows of a vocabulary, without a shuffle of terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.operators.blockmatch import from_bytes, packed

TEXT_ROWS = 2048       # texts in a block
MODEL_ROWS = 1 << 14   # terms in a block


def met(texts: DataFrame, rows: DataFrame, columns: list[str], make, schema: T.StructType) -> DataFrame:
    """Every block of texts beside the model rows of its terms: ``make(blocks,
    model)`` yields record batches for a task's blocks.  A task holds
    its own blocks and streams the blocks of ``rows(term, ...)`` past them,
    keeping the rows of its own terms, so no text is shuffled."""
    rows = rows.select(F.col("term").alias("id"), *columns)
    # a term that no text has: with an empty vocabulary every text is still met
    none = rows.sparkSession.range(1).select(F.lit("").alias("id"), *[(F.array() if isinstance(f.dataType, T.ArrayType) else F.lit(0)).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:]])
    model = packed(rows.unionAll(none), MODEL_ROWS, "r").repartition(1)

    def task(batches):
        held, kept, number, table, terms = {}, [], None, None, None

        def keep():
            kept.append(table.filter(pc.is_in(table["id"], value_set=terms)))

        def own_terms():
            found = pa.array([], pa.string())
            for data in held.values():
                found = pc.unique(pa.concat_arrays([found, flat(from_bytes(data), "terms")]))
            return found

        for batch in batches:
            for r, r_rows, n, n_rows in zip(*batch.columns):
                if number != r.as_py():
                    if table is not None:
                        terms = own_terms() if terms is None else terms
                        keep()
                    number, table = r.as_py(), from_bytes(r_rows)
                if terms is None:  # the first block of the model meets all texts
                    held[n.as_py()] = n_rows
        if table is not None:
            terms = own_terms() if terms is None else terms
            keep()
            model = pa.concat_tables(kept).combine_chunks()
            yield from make((from_bytes(data) for data in held.values()), model)

    return model.hint("shuffle_replicate_nl").crossJoin(texts).mapInArrow(task, schema)


def column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks or [pa.array([], table.schema.field(name).type)])


def flat(table: pa.Table, name: str) -> pa.Array:
    return column(table, name).flatten()


def entries(texts: pa.Table, weights: str, model: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the model and weight of every entry with a known term."""
    place = pc.fill_null(pc.index_in(flat(texts, "terms"), value_set=column(model, "id")), -1).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(texts["terms"]).to_numpy(zero_copy_only=False)
    row, known = np.repeat(np.arange(len(texts)), size), place >= 0
    weight = flat(texts, weights).to_numpy(zero_copy_only=False).astype(float)
    return row[known], place[known], weight[known]
