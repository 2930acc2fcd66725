"""Headers of model files (GGUF, versions 2 and 3): architecture, sizes, parameters and quantization of each file."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Names of file types and of tensor types by number, and the most entries that a header may announce.
FILE_TYPES = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 7: "Q8_0", 8: "Q5_0", 9: "Q5_1", 10: "Q2_K", 11: "Q3_K_S", 12: "Q3_K_M", 13: "Q3_K_L", 14: "Q4_K_S",
    15: "Q4_K_M", 16: "Q5_K_S", 17: "Q5_K_M", 18: "Q6_K", 19: "IQ2_XXS", 20: "IQ2_XS", 21: "Q2_K_S", 22: "IQ3_XS", 23: "IQ3_XXS", 24: "IQ1_S",
    25: "IQ4_NL", 26: "IQ3_S", 27: "IQ3_M", 28: "IQ2_S", 29: "IQ2_M", 30: "IQ4_XS", 31: "IQ1_M", 32: "BF16",
}
TENSOR_TYPES = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 6: "Q5_0", 7: "Q5_1", 8: "Q8_0", 10: "Q2_K", 11: "Q3_K", 12: "Q4_K", 13: "Q5_K", 14: "Q6_K",
    16: "IQ2_XXS", 17: "IQ2_XS", 18: "IQ3_XXS", 19: "IQ1_S", 20: "IQ4_NL", 21: "IQ3_S", 22: "IQ2_S", 23: "IQ4_XS", 29: "IQ1_M", 30: "BF16",
}
MOST = 1_000_000
#: Value types: format of each number; 8 is a string and 9 a list.
NUMBERS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}

SCHEMA = (
    "path string, error string, architecture string, name string, tokenizer string, context_length long, block_count long, "
    "embedding_length long, parameters long, quantization string"
)


class Reader:
    """Little-endian values of a file, one after the other; running past the end is an error."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("the header ends too early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, form: str = "<Q"):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def count(self) -> int:
        n = self.number()
        if n > MOST:
            raise ValueError("the header announces too many entries")
        return n

    def text(self) -> str:
        return self.take(self.number()).decode(errors="replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.number("<I"), self.number()
            if inner in NUMBERS:
                self.take(n * struct.calcsize(NUMBERS[inner]))
            else:
                for _ in range(min(n, len(self.raw))):
                    self.value(inner)
            return None
        if kind not in NUMBERS:
            raise ValueError("unknown type of value")
        return self.number(NUMBERS[kind])


def header(raw: bytes) -> dict:
    """The columns of SCHEMA but for the path."""
    read = Reader(raw)
    if read.take(4) != b"GGUF":
        raise ValueError("not a model file")
    if (version := read.number("<I")) not in (2, 3):
        raise ValueError(f"version {version} isn't known")
    n_tensors, n_keys = read.count(), read.count()
    keys = {}
    for _ in range(n_keys):
        key = read.text()
        keys[key] = read.value(read.number("<I"))
    parameters, types = 0, Counter()
    for _ in range(n_tensors):
        read.text()
        elements = 1
        for _ in range(min(read.number("<I"), MOST)):
            elements *= read.number()
        types[read.number("<I")] += 1
        read.number()
        parameters += elements
    architecture = keys.get("general.architecture")
    whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else None
    types.pop(0, None)
    # the commonest type, of equally common ones the least
    common = min(types, key=lambda t: (-types[t], t), default=None)
    return {
        "architecture": architecture, "name": keys.get("general.name"), "tokenizer": keys.get("tokenizer.ggml.model"),
        **{c: whole(keys.get(f"{architecture}.{c}")) for c in ("context_length", "block_count", "embedding_length")},
        "parameters": min(parameters, (1 << 63) - 1) or None,
        "quantization": FILE_TYPES.get(keys.get("general.file_type")) or TENSOR_TYPES.get(common),
    }


def model_headers(files: DataFrame) -> DataFrame:
    """SCHEMA for each file; one that can't be read has the reason in `error`. `files`: path, content (its beginning will do)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def one(path: str, raw: bytes) -> dict:
        try:
            return {"path": path, **header(raw)}
        except ValueError as e:
            return {"path": path, "error": str(e)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [one(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            table = pd.DataFrame(rows, columns=names).astype(object)
            yield table.where(table.notna(), None)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
