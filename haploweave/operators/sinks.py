"""FASTA files and one-hot arrays from results."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_text(results: DataFrame, width: int = 60) -> DataFrame:
    """sample, haplotype (``_ref`` and ``all`` for null), gene_id and the file's text; a failed task has its error in the header."""
    head = F.concat(F.lit(">"), F.col("gene_id"), F.when(F.col("error").isNotNull(), F.concat(F.lit(" ERROR="), F.col("error"))).otherwise(""))
    body = F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    return results.select(F.coalesce("sample", F.lit("_ref")).alias("sample"), F.coalesce("haplotype", F.lit("all")).alias("haplotype"), "gene_id", F.concat_ws("\n", head, F.nullif(body, F.lit(""))).alias("text"))


def write_fasta(results: DataFrame, path: str) -> int:
    """One file ``<path>/<sample>/<gene_id>.<haplotype>.fa`` a task, written by the tasks of the job; path is a folder or URI that executors share.

    A file gets its name when it is whole, so a repeated task replaces it. Results of one name are one file, the last written;
    a slash in a name becomes an underscore. Returns the number of files written.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path if re.match(r"\w+://", path) else f"file://{path}")
        made = set()
        for batch in batches:
            for r in batch.to_pylist():
                folder, name = (re.sub("/", "_", x) for x in (r["sample"], f"{r['gene_id']}.{r['haplotype']}.fa"))
                if folder not in made:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                part = f"{root}/{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(r["text"].encode() + b"\n")
                store.move(part, f"{root}/{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return fasta_text(results).mapInArrow(files, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def one_hot(seq: Column | str, other: bool = False) -> Column:
    """array<array<int>>: A, C, G, T in any case to channels 0 to 3; else a fifth channel, or all zero."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    channels = 5 if other else 4

    def row(c: Column) -> Column:
        at = F.position(F.upper(c), F.lit("ACGT")) - 1
        at = F.when(at < 0, F.lit(4)).otherwise(at)
        return F.array(*[(at == i).cast("int") for i in range(channels)])

    return F.transform(F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>")), row)
