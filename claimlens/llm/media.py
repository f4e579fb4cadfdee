"""Operator 7, media columns: audio features.

A payload is stored losslessly as 8-bit samples of a WAV file (one byte a sample) and read
back from the stored bytes. The samples are resampled by a polyphase filter (2 to 5), cut
into overlapped Hann windows, turned to log-mel bands, and segmented by energy with two
thresholds (a stretch begins over the upper and lasts until under the lower). Frames are
averaged in BINS equal time spans, so each recording gives one tensor of fixed shape
BINS x MELS beside the spans' times; a block's tensors are stored as Arrow fixed-shape
tensors in an Arrow stream, and features are told from that.

Each row is a map of its own; nothing is shuffled. Equal payloads give equal values.

Defined results: a null or empty text is one unit of padding; repeated rows give one row
each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, documents, id_and_text

RATE, UP, DOWN = 16_000, 2, 5
FRAME, HOP, MELS, BINS = 256, 128, 32, 16
UNIT, PAD = 576, 255
LOUD, QUIET = 0.5, 0.1

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, log_mel array<float>, bin_seconds array<float>, segments array<array<float>>"


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples; a pad byte follows an odd number of them."""
    data = samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + data


def samples_of(media: bytes) -> bytes:
    (size,) = struct.unpack_from("<I", media, 40)
    return media[44 : 44 + size]


def _filter() -> np.ndarray:
    """Taps of a windowed sinc low-pass, one row per phase."""
    taps = 16 * UP
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(taps)
    return (h * UP / h.sum()).astype(np.float32).reshape(-1, UP).T[:, ::-1].copy()


def _bands() -> np.ndarray:
    """Triangular mel bands over the spectrum of a frame."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    at = 700 * (10 ** (mel / 2595) - 1) * FRAME / rate
    k = np.arange(FRAME // 2 + 1)[:, None]
    rise, fall = (k - at[:-2]) / np.maximum(at[1:-1] - at[:-2], 1e-9), (at[2:] - k) / np.maximum(at[2:] - at[1:-1], 1e-9)
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


TAPS, BANDS, HANN = _filter(), _bands(), np.hanning(FRAME).astype(np.float32)


def resampled(x: np.ndarray) -> np.ndarray:
    """UP / DOWN times the samples, each phase of the filter applied only where it is kept."""
    width = TAPS.shape[1]
    x = np.pad(x, (width - 1, width))
    n = (len(x) - 2 * width + 1) * UP // DOWN
    windows = np.lib.stride_tricks.sliding_window_view(x, width)
    out = np.empty(n, np.float32)
    for first in range(min(UP, n)):
        at = np.arange(first, n, UP) * DOWN
        out[first::UP] = windows[at // UP] @ TAPS[(first * DOWN) % UP]
    return out


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Log-mel bands of each overlapped frame, a long recording in parts."""
    y = resampled((samples.astype(np.float32) - 128) / 128)
    y = np.pad(y, (0, max(0, FRAME - len(y))))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    return np.vstack([np.log(np.abs(np.fft.rfft(frames[a : a + 4096] * HANN)).astype(np.float32) ** 2 @ BANDS + 1e-6) for a in range(0, len(frames), 4096)])


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of frames that begin over the upper threshold and end under the lower, in deviations from the mean."""
    z = (energy - energy.mean()) / (energy.std() + 1e-6)
    mark = np.where(z > LOUD, 1, np.where(z < QUIET, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], int]:
    """The fixed-shape tensor, the seconds where its bins begin and end, segments, and the frames."""
    mel = log_mel(samples)
    n = len(mel)
    edges = np.arange(BINS + 1) * n // BINS
    total = np.vstack([np.zeros(MELS), np.cumsum(mel, 0, dtype=np.float64)])
    size = np.diff(edges)
    bins = (total[edges[1:]] - total[edges[:-1]]) / np.maximum(size, 1)[:, None]
    step = HOP * DOWN / (UP * RATE)
    return bins.astype(np.float32), (edges * step).astype(np.float32), segments(mel.mean(1)), n


def tensors(doc_ids: list, mels: list[np.ndarray], seconds: list[np.ndarray], spans: list[list[list[float]]]) -> bytes:
    """An Arrow stream of one block: doc_id, log_mel and bin_seconds as fixed-shape tensors, and the time spans of the segments."""
    batch = pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack(mels)), pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack(seconds)), pa.array(spans, pa.list_(pa.list_(pa.float32())))],
        names=["doc_id", "log_mel", "bin_seconds", "segments"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.Table:
    """The table of a stored block, its tensors in their shapes."""
    return pa.ipc.open_stream(data).read_all()


def of_block(block: pa.RecordBatch) -> tuple[list[tuple], bytes]:
    """What is told of each stored recording of a block, and the block's tensors."""
    step = HOP * DOWN / (UP * RATE)
    told, mels, seconds, spans, frames = [], [], [], [], []
    for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
        raw = text.encode()
        media = wav(raw + bytes([PAD]) * (max(-(-len(raw) // UNIT), 1) * UNIT - len(raw)))
        back = samples_of(media)
        tensor, at, parts, n = features(np.frombuffer(back, np.uint8))
        told.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest()))
        mels.append(tensor)
        seconds.append(at)
        spans.append([[x * step, y * step] for x, y in parts])
        frames.append((n, sum(y - x for x, y in parts)))
    data = tensors([t[0] for t in told], mels, seconds, spans)
    kept = opened(data)  # features are told from what is stored
    mel = kept["log_mel"].combine_chunks().to_numpy_ndarray()
    out = []
    for k, (own, (n, loud)) in enumerate(zip(told, frames, strict=True)):
        digest = hashlib.md5(np.round(mel[k], 2).tobytes(), usedforsecurity=False).hexdigest()
        out.append((*own, f"frames={n};segments={len(spans[k])};loud={loud};mel={digest}"))
    return out, data


def recordings(docs: DataFrame) -> DataFrame:
    """One row per document: its stored form's sizes and digests, and the features; see SCHEMA."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out, data = of_block(block)
            c = list(zip(*out, strict=True))
            arrays = [pa.array(c[k], pa.int64() if k in (0, 1, 2, 4, 5) else pa.string()) for k in range(8)]
            kept = opened(data)
            lists = [kept[x].combine_chunks().storage.cast(pa.list_(pa.float32())) for x in ("log_mel", "bin_seconds")]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*arrays, *lists, kept["segments"].combine_chunks()], names=names)

    return id_and_text(docs).mapInArrow(task, SCHEMA)


def tensor_blocks(docs: DataFrame) -> DataFrame:
    """The features as they are stored: one row per block of documents, with its Arrow stream (``opened`` reads it) and how many it holds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            _, data = of_block(block)
            yield pa.RecordBatch.from_arrays([pa.array([block.num_rows], pa.int64()), pa.array([data], pa.binary())], names=["documents", "arrow"])

    return id_and_text(docs).mapInArrow(task, "documents long, arrow binary")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings(documents(spark, sf_dir)).drop("log_mel", "bin_seconds", "segments")
