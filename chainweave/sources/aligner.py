"""Pairwise alignments from an external aligner, fed through its standard input on the executors."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from chainweave.sources.readers import PAF_COLUMNS

# fixed presets: sensitive for small queries, fast for queries above six million bytes
SMALL_PRESET = "-x asm20 -p 0.1 -N 1000 -c -s 0"
LARGE_PRESET = "-x asm5 -p 0.1 -N 10 -c -s 0"
LARGE_QUERY = 6_000_000


def aligner_command(reference: str, query_bytes: int = 0, program: str = "minimap2") -> list[str]:
    """Command line that aligns FASTA records on standard input to ``reference`` and prints PAF."""
    preset = LARGE_PRESET if query_bytes > LARGE_QUERY else SMALL_PRESET
    return [program, *shlex.split(preset), reference, "-"]


def align(seqs: DataFrame, command: Sequence[str]) -> DataFrame:
    """Run the aligner once per Arrow batch of ``(name, seq)`` rows; its PAF lines become rows.

    The reference (or its index) has to be readable at the same path on every executor. A failing aligner
    fails the task, which Spark tries again elsewhere.
    """
    names, command = list(PAF_COLUMNS), list(command)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fasta = "".join(f">{n}\n{s}\n" for n, s in zip(batch["name"], batch["seq"]))
            done = subprocess.run(command, input=fasta, capture_output=True, text=True, check=True)
            rows = [line.split("\t")[: len(names)] for line in done.stdout.splitlines() if line]
            out = pd.DataFrame(rows, columns=names)
            for column, kind in PAF_COLUMNS.items():
                if kind != "string":
                    out[column] = out[column].astype("int32" if kind == "int" else "int64")
            yield out

    schema = ", ".join(f"{n} {t}" for n, t in PAF_COLUMNS.items())
    return seqs.select("name", "seq").mapInPandas(run, schema)
