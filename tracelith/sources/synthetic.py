"""Synthetic traces of a transformer's training: the same spec gives the same trace."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.adapters import EVENT

_MASK = (1 << 64) - 1


# The defaults, the generator's constants, lanes, names, gaps and the order of draws give the known totals of such traces.


@dataclass(frozen=True)
class Spec:
    gpus: int = 4
    layers: int = 4
    iterations: int = 2
    ops: int = 6
    op_dur: int = 50
    seed: int = 0xCAFEBABE


def draw(seed: int, n: int) -> int:
    """The n-th (from 0) value of splitmix64: its state only counts, so any value can be had without those before."""
    z = (seed + (n + 1) * 0x9E3779B97F4A7C15) & _MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
    return z ^ z >> 31


def rank_events(spec: Spec, rank: int) -> Iterator[tuple]:
    """The events of one rank. Durations take draws in order: forward, then backward, iteration by iteration, ranks one after another."""
    at = rank * spec.iterations * spec.layers * spec.ops * 2
    # A signed draw's remainder by 8, never negative, is that of its low bits.
    jitter = lambda: spec.op_dur + (draw(spec.seed, at) & 7)
    rows: dict[str, list[tuple]] = {"cpu_thread": [], "stream 7": [], "stream 12": []}
    now, correlation = 0, 1
    put = lambda lane, name, ts, dur, cat, args: rows[lane].append((name, ts, dur, cat, args))
    for _ in range(spec.iterations):
        for layer in range(spec.layers):
            for op in range(spec.ops):
                dur, at = jitter(), at + 1
                args = {"correlation": str(correlation)}
                put("cpu_thread", f"layers.{layer}.attn.op_{op}", now, dur, "cpu_op", args)
                put("stream 7", f"kernel_{op}", now + 1, dur - 2, "kernel", args)
                now, correlation = now + dur + 1, correlation + 1
            put("stream 12", "nccl:all_reduce", now, 20, "kernel", {"Process Group Name": '"tp_group"'})
            now += 25
        for layer in reversed(range(spec.layers)):
            for op in reversed(range(spec.ops)):
                dur, at = jitter(), at + 1
                put("cpu_thread", f"layers.{layer}.attn.op_{op}.backward", now, dur, "cpu_op", None)
                now += dur + 1
    seq = 0
    for lane, events in rows.items():
        for name, ts, dur, cat, args in events:
            yield str(rank), 100 + rank, lane, "X", seq, name, ts, dur, cat, None, None, None, args
            seq += 1


def generate(spark: SparkSession, spec: Spec = Spec()) -> DataFrame:
    """The trace in the event schema; each rank is made by itself, in parallel."""
    import pandas as pd

    names = [x.split(" ")[0] for x in EVENT.split(", ")]

    def run(batches):
        for b in batches:
            for rank in b["id"]:
                yield pd.DataFrame(list(rank_events(spec, int(rank))), columns=names).astype({"id": "Int64"})

    return spark.range(0, spec.gpus, 1, spec.gpus).mapInPandas(run, EVENT)
