"""Token ids of whole Arrow columns, with caches that live as long as the Python worker.

For a tokenizer that drops white space, the ids of a text are those of its white-space separated
pieces one after another, so each distinct piece of a batch is encoded once and found again through
a bounded cache. Special strings hold no white space and stay inside their piece. Whether a tokenizer
is of that kind is read from its file; any other one encodes whole texts.
"""

import array
import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fareloom.llm.textwords import split_words

#: Distinct pieces in one generation of a cache and characters of them; two generations exist at a time.
CACHE_PIECES, CACHE_CHARACTERS = 400_000, 8_000_000
#: Longer pieces (text without white space) are encoded each time.
CACHED_PIECE = 256

#: The steps in front of the vocabulary that cut at white space and drop it, and that
#: lower-case and cut between a letter and the punctuation below.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """One tokenizer for each file and worker; Spark's tasks are the only parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=4)
def drops_white_space(path: str) -> bool:
    """True for a tokenizer that lower-cases, cuts at white space and between letters and punctuation, and drops white space."""
    spec = json.loads(load_tokenizer(path).to_str())
    normalizer, before = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    special = (t["normalized"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return normalizer.get("normalizers") == _NORMALIZERS and before.get("pretokenizers", [None])[0] == _SPLIT and not any(special)


class PieceCache:
    """Piece -> value in two generations: the older one is dropped when the younger one is full."""

    def __init__(self, compute, limit: int = CACHE_PIECES, characters: int = CACHE_CHARACTERS):
        self.compute, self.limit, self.characters, self.held = compute, limit, characters, 0
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, pieces: list) -> list:
        young, old = self.young, self.old
        found = [young.get(p) for p in pieces]
        missing = []
        for k, value in enumerate(found):
            if value is None:
                value = old.get(pieces[k])
                if value is None:
                    missing.append(k)
                else:
                    found[k] = young[pieces[k]] = value
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            for k, value in zip(part, self.compute([pieces[k] for k in part]), strict=True):
                found[k] = value
                if len(pieces[k]) <= CACHED_PIECE:
                    young[pieces[k]] = value
                    self.held += len(pieces[k])
        if len(young) > self.limit or self.held > self.characters:
            self.young, self.old, self.held = {}, young, 0
        return found


@functools.lru_cache(maxsize=4)
def id_cache(path: str) -> PieceCache:
    tokenizer = load_tokenizer(path)

    def encode(pieces: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    return PieceCache(encode)


def _fewer_pieces(texts: pa.Array) -> pa.Array:
    """The same ids from fewer distinct pieces: A-Z lower-cased, a space where a letter meets punctuation.

    The tokenizer lower-cases and cuts there itself. Texts with combining marks, which may join a
    letter of one case only, or with the opening of a special string are left as they are.
    """
    plain = pc.invert(pc.match_substring_regex(texts, pattern=r"\pM|<\|"))
    cut = pc.replace_substring_regex(texts, pattern=r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:*$%&#\"()])", replacement=r"\1 \2")
    return pc.if_else(plain, pc.ascii_lower(cut), texts)


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text followed by ``end_id``.

    Returns the ids (unsigned 32-bit), the bounds of the texts, and the positions behind which a
    sentence ends (inside texts; the ends of texts are in the bounds).
    """
    if not drops_white_space(path):
        return _encode_whole(texts, path, end_id)
    batch = split_words(_fewer_pieces(texts))
    pieces = batch.words.to_pylist()
    blobs = id_cache(path).look_up(pieces)
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(blobs), "<u4")
    n, codes, offsets = len(texts), batch.codes, batch.offsets
    size = lengths[codes]
    before = np.concatenate([[0], np.cumsum(size)])
    per_text = np.diff(before[offsets])
    bounds = np.concatenate([[0], np.cumsum(per_text + 1)])
    ids = np.full(int(bounds[-1]), end_id, "<u4")
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    target = before[:-1] + text_of  # one end id behind each earlier text
    if len(codes):
        step = np.arange(int(before[-1])) - np.repeat(before[:-1], size)
        ids[np.repeat(target, size) + step] = flat[np.repeat(starts[codes], size) + step]
    stops = np.fromiter((p.endswith((".", "!", "?")) for p in pieces), bool, len(pieces))
    sentence_ends = (target + size)[stops[codes]] if len(codes) else np.zeros(0, np.int64)
    return ids, bounds, sentence_ends


@functools.lru_cache(maxsize=4)
def _sentence_end_ids(path: str) -> np.ndarray:
    vocabulary = load_tokenizer(path).get_vocab()
    return np.array([k for token, k in vocabulary.items() if token.removesuffix("</w>").endswith((".", "!", "?"))], np.int64)


def _encode_whole(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    encoded = load_tokenizer(path).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
    ids = np.fromiter((k for e in encoded for k in (*e.ids, end_id)), "<u4")
    bounds = np.concatenate([[0], np.cumsum([len(e.ids) + 1 for e in encoded], dtype=np.int64)])
    ends = np.flatnonzero(np.isin(ids, _sentence_end_ids(path))) + 1
    return ids, bounds, np.setdiff1d(ends, np.concatenate([bounds, bounds[1:] - 1]))
