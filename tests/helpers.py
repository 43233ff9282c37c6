"""Small traces for tests."""

import gzip
import json

from tracelith.plans.adapters import EVENT


def events(spark, rows):
    """Events from dicts; what a dict leaves out is null, or the default."""
    names = [x.split(" ")[0] for x in EVENT.split(", ")]
    base = {"rank": "0", "pid": 7, "tid": "cpu", "ph": "X", "name": "op", "ts": 0}
    full = [base | {"seq": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], EVENT)


#: Two records about processes, two operators that share a pattern but not their optional fields, a kernel whose stream stands in its arguments.
TINY = {
    "traceEvents": [
        {"ph": "X", "name": "block.3.mlp.07.gelu", "cat": "host", "pid": 31, "tid": "main", "ts": 52_040, "dur": 25, "id": 5, "s": "p", "args": {"External id": 900, "shape": [4, 2.0]}},
        {"ph": "M", "name": "thread_name", "pid": 31, "tid": "main", "args": {"label": "trainer"}},
        {"ph": "X", "name": "block.4.mlp.08.gelu", "cat": "host", "pid": 31, "tid": "main", "ts": 52_000, "args": {"note": "no duration"}},
        {"ph": "X", "name": "gemm_128x64", "cat": "device", "pid": 0, "tid": 99, "ts": 52_011, "dur": 14, "args": {"stream": 20}},
        {"ph": "M", "name": "process_labels", "pid": 0, "tid": 99},
    ],
    "distributedInfo": {"rank": 3, "world_size": 16},
}


def put(path, value=TINY):
    raw = value if isinstance(value, bytes) else value.encode() if isinstance(value, str) else json.dumps(value).encode()
    path.write_bytes(gzip.compress(raw) if path.name.endswith(".gz") else raw)
    return str(path)
