"""One direction of an LSTM, step by step, as a graph for ONNX Runtime: its gates are several times faster than numpy's."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Where it is absent, the same scores come from numpy.
try:
    import onnxruntime
except ImportError:
    onnxruntime = None

#: Steps of a graph; states pass from one run to the next.
STEPS = 32
# Numbers that the format (ONNX, IR version 8, operators 14) fixes.
_FLOAT, _INT64 = 1, 7


def _field(number: int, value: int | str | bytes) -> bytes:
    """A field of a protocol buffer."""

    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _node(op: str, ins: list[str], outs: list[str], **numbers: int) -> bytes:
    attributes = [_field(1, k) + _field(3, v) + _field(20, 2) for k, v in numbers.items()]
    return b"".join(_field(k, x) for k, own in ((1, ins), (2, outs), (4, [op]), (5, attributes)) for x in own)


def _constant(name: str, a: np.ndarray) -> bytes:
    kind = {"f": _FLOAT, "i": _INT64}[a.dtype.kind]
    return b"".join(_field(1, n) for n in a.shape) + _field(2, kind) + _field(8, name) + _field(9, np.ascontiguousarray(a).tobytes())


def _value(name: str, sizes: list[str]) -> bytes:
    shape = b"".join(_field(1, _field(2, s)) for s in sizes)
    return _field(1, name) + _field(2, _field(1, _field(1, _FLOAT) + _field(2, shape)))


def graph(of_state: np.ndarray, out: np.ndarray) -> bytes:
    """STEPS steps: what symbols give to the gates (x1, x2, ..., each of batch, 4 units), h and c (batch, unit) to
    emissions (step and tag, batch), h and c. Gates stand in the order input, forget, output, fresh.
    """
    n, steps = len(of_state), range(1, STEPS + 1)
    constants = {"of_state": of_state, "out": out.T, "gates": np.full(4, n, np.int64)}
    nodes = []
    for t in steps:
        nodes += [
            _node("Gemm", [f"h{t - 1}", "of_state", f"x{t}"], [f"z{t}"]),
            _node("Split", [f"z{t}", "gates"], [f"zi{t}", f"zf{t}", f"zo{t}", f"zg{t}"], axis=1),
            *[_node("Sigmoid", [f"z{g}{t}"], [f"{g}{t}"]) for g in "ifo"],
            _node("Tanh", [f"zg{t}"], [f"g{t}"]),
            _node("Mul", [f"i{t}", f"g{t}"], [f"new{t}"]),
            _node("Mul", [f"f{t}", f"c{t - 1}"], [f"kept{t}"]),
            _node("Add", [f"new{t}", f"kept{t}"], [f"c{t}"]),
            _node("Tanh", [f"c{t}"], [f"th{t}"]),
            _node("Mul", [f"o{t}", f"th{t}"], [f"h{t}"]),
            _node("Gemm", ["out", f"h{t}"], [f"e{t}"], transB=1),
        ]
    nodes.append(_node("Concat", [f"e{t}" for t in steps], ["scores"], axis=0))
    inputs = [*[_value(f"x{t}", ["batch", "gate"]) for t in steps], *[_value(f"{x}0", ["batch", "unit"]) for x in "hc"]]
    outputs = [_value("scores", ["place", "batch"]), *[_value(f"{x}{STEPS}", ["batch", "unit"]) for x in "hc"]]
    parts = ((1, nodes), (2, ["steps"]), (5, [_constant(k, a) for k, a in constants.items()]), (11, inputs), (12, outputs))
    return _field(1, 8) + _field(7, b"".join(_field(k, x) for k, own in parts for x in own)) + _field(8, _field(2, 14))


@lru_cache(8)
def session(made: bytes):
    """A session of a graph, in one thread as Spark deals the work; a worker keeps it over its tasks."""
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(made, options, providers=["CPUExecutionProvider"])


def add_scores(run, of_symbol: np.ndarray, symbols: np.ndarray, scores: np.ndarray) -> None:
    """Add a direction's emissions to ``scores`` (time, tag, batch). ``of_symbol`` (symbol, 4 units) holds the
    bias; ``symbols`` (time, batch) and ``scores`` are reversed for the second direction; time is a multiple of STEPS."""
    batch = symbols.shape[1]
    h = c = np.zeros((batch, of_symbol.shape[1] // 4), np.float32)
    x = np.empty((STEPS, batch, of_symbol.shape[1]), np.float32)
    names = [f"x{t}" for t in range(1, STEPS + 1)]
    for at in range(0, len(symbols), STEPS):
        for row, own in zip(x, symbols[at : at + STEPS], strict=True):
            of_symbol.take(own, axis=0, out=row, mode="clip")
        e, h, c = run.run(["scores", f"h{STEPS}", f"c{STEPS}"], {**dict(zip(names, x, strict=True)), "h0": h, "c0": c})
        scores[at : at + STEPS] += e.reshape(STEPS, -1, batch)
