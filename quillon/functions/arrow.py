"""Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.functions.text import STOP_WORDS

#: Bytes of a batch that a worker turns into Python objects at once.
SLICE_BYTES = 1 << 20


def sliced(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `size` bytes, or of one row; rows differ in length, so each is weighed."""
    for batch in batches:
        upto = np.cumsum(sum((_bytes(c) for c in batch.columns), np.zeros(batch.num_rows, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, size + (upto[at - 1] if at else 0), side="right")))
            yield batch.slice(at, end - at)
            at = end


def _bytes(column: pa.Array) -> np.ndarray:
    """About how many bytes each row of a column holds."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)) if len(column) else np.zeros(0, dtype=np.int64)
    if pa.types.is_list(column.type):
        return 16 * column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), -(-column.nbytes // max(1, len(column))), dtype=np.int64)


#: By byte: 1 for what words are made of, 2 for what joins them inside a keyword; and the byte in lower case.
_KINDS = np.array([1 if chr(b).isalnum() and b < 128 else 2 if chr(b) in ".,'-" else 0 for b in range(256)], dtype=np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: The only characters beyond ASCII whose lower case holds a letter of ASCII.
_LOWER_TO_ASCII = (("\u212a", "k"), ("\u0130", "i\u0307"))


def keywords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """The keywords of texts as functions.text.tokens finds them: each one's row and its place in the dictionary, and the dictionary.

    Found for all texts at once on their bytes, so no object is made for a word. The dictionary may hold words that no row has.
    """
    texts = texts.cast(pa.string()).fill_null("")
    for upper, lower in _LOWER_TO_ASCII:
        texts = pc.replace_substring(texts, upper, lower)
    _, places, data = texts.buffers()
    places = np.frombuffer(places, dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset) if len(texts) else np.zeros(1, dtype=np.int32)
    raw = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    places, kind = places - places[0], _KINDS[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[places] = True  # a keyword doesn't go on into the next text
    held = kind == 1
    joined = np.flatnonzero(kind == 2)
    joined = joined[(joined > 0) & (joined < len(raw) - 1)]
    held[joined[held[joined - 1] & held[joined + 1] & ~first[joined] & ~first[joined + 1]]] = True
    opens = held & first[:-1]
    opens[1:] |= held[1:] & ~held[:-1]
    opens[:1] = held[:1]
    at = np.flatnonzero(opens)
    kept = _LOWER[raw[held]]
    starts = np.r_[np.cumsum(held)[at] - 1, len(kept)].astype(np.int32)
    coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(kept)).dictionary_encode()
    codes, row = coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(places, at, side="right") - 1
    wanted = ~pc.is_in(coded.dictionary, value_set=pa.array(STOP_WORDS, pa.string())).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, dtype=bool)
    return row[wanted], codes[wanted].astype(np.int64), coded.dictionary
