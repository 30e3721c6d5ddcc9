"""BPE encoding and decoding with forced boundaries, for tokenizer files with word ends (`</w>`).

A pair of bytes that stands inside no vocabulary token can never be spanned by a token, so each such pair is a certain
cut. Every word is cut there, the fragments are encoded independently by the file's merges (the last with its word
end, the others without) and the ids concatenated.

Edge cases: a null or empty text has no ids and decodes to the empty text; repeated rows give repeated results; columns
other than doc_id and text are ignored; the strings of special tokens in a text become those tokens.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct words in each of the two generations that a Python worker remembers.
REMEMBERED_WORDS = 250_000
_loaded: dict[str, Vocabulary] = {}


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Vocabulary:
    """A tokenizer file's vocabulary, its forced cuts and a bounded memory of encoded words."""

    def __init__(self, text: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.array([""] * (1 + max([*self.vocab.values(), *self.special.values()])), dtype=object)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = Tokenizer(models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix))
        self.inner = Tokenizer(models.BPE(vocab=self.vocab, merges=merges))
        self.last.pre_tokenizer = self.inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.cut = np.ones((256, 256), bool)
        for t in self.vocab:
            b = bytes(back[c] for c in t.removesuffix(self.suffix) if c in back)
            for x, y in zip(b, b[1:], strict=False):
                self.cut[x, y] = False
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"].replace(r"^\s", r"^\p{White_Space}"))
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pieces(self, word: bytes) -> list[bytes]:
        """The pre-tokens of a word as bytes, in lower case."""
        if word.isalpha():  # ASCII letters only
            return [word.lower()]
        # Lower case is taken letter by letter, so a final capital sigma gives the ordinary small one.
        text = unicodedata.normalize("NFC", word.decode("utf-8", "replace")).replace("Σ", "σ").lower()
        return [p.encode() for p in self.piece.findall(text)]

    def fragments(self, pieces: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All pieces cut at forced boundaries: the fragments, the piece of each, and whether it ends its piece."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        last = np.zeros(len(data) + 1, bool)
        last[ends] = True
        here = last.copy()
        here[1:-1] |= self.cut[data[:-1], data[1:]]
        stops = np.flatnonzero(here)
        raw, text, lo = data.tobytes().decode("latin-1"), [], 0
        for hi in stops.tolist():
            text.append(raw[lo:hi])
            lo = hi
        text = [t if t.isascii() and t.isprintable() else t.translate(self.letters) for t in text]
        return text, np.searchsorted(ends, stops, side="left"), last[stops]

    def merge(self, fragments: list[str], final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all fragments in order, and the fragment of each. Byte letters hold no white space, so one call
        encodes many fragments, each on its own."""
        ids, owner = [], []
        for coder, chosen in ((self.last, final), (self.inner, ~final)):
            at = np.flatnonzero(chosen)
            if len(at):
                e = coder.encode(" ".join([fragments[i] for i in at.tolist()]), add_special_tokens=False)
                ids.append(np.array(e.ids, np.int32))
                owner.append(at[np.array(e.word_ids, np.int64)])
        all_ids, all_owners = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(all_owners, kind="stable")
        return all_ids[order], all_owners[order]

    def learn(self, words: list[bytes]) -> None:
        """Encodes words that are not remembered yet."""
        if len(self.known) + len(words) > REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        marked = [w for w in words if self.marks is not None and b"<|" in w]
        for w in marked:
            self.known[w] = b"".join(self._with_specials(w.decode("utf-8", "replace")))
        plain = words if not marked else [w for w in words if w not in self.known]
        cut = [self.pieces(w) for w in plain]
        pieces = [p for c in cut for p in c]
        if not pieces:
            self.known.update((w, b"") for w in plain)
            return
        text, piece, final = self.fragments(pieces)
        ids, fragment = self.merge(text, final)
        word = np.repeat(np.arange(len(plain)), [len(c) for c in cut])[piece][fragment]
        at = (4 * np.searchsorted(word, np.arange(len(plain) + 1))).tolist()
        raw = ids.tobytes()
        self.known.update((w, raw[a:b]) for w, a, b in zip(plain, at, at[1:], strict=False))

    def _with_specials(self, text: str) -> Iterator[bytes]:
        """A word that may hold strings of special tokens, which stand for those tokens."""
        lo = 0
        for m in [*self.marks.finditer(text), None]:
            pieces = self.pieces(text[lo : m.start() if m else len(text)].encode())
            if pieces:
                f, _, final = self.fragments(pieces)
                yield self.merge(f, final)[0].tobytes()
            if m:
                yield np.int32(self.special[m[0]]).tobytes()
                lo = m.end()

    def prepare(self, words: set[bytes]) -> None:
        """Makes sure that all these words are remembered, if they aren't too many."""
        known, older, new = self.known, self.older, []
        for w in words:
            if w not in known:
                if (ids := older.get(w)) is None:
                    new.append(w)
                else:
                    known[w] = ids
        if new:
            self.learn(new)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as 32-bit integers. bytes.split cuts exactly at ASCII white space, which no piece spans."""
        words, out = text.split(), []
        for lo in range(0, len(words), REMEMBERED_WORDS // 4):
            part = words[lo : lo + REMEMBERED_WORDS // 4]
            try:
                out.append(b"".join([self.known[w] for w in part]))
            except KeyError:
                self.prepare(set(part))
                if not all(w in self.known for w in part):  # the memory was renewed meanwhile
                    self.prepare(set(part))
                out.append(b"".join([self.known[w] for w in part]))
        return b"".join(out)


def vocabulary(text: str) -> Vocabulary:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def texts_of(v: Vocabulary, at: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The tokens of each run of ids joined by one space, as the file has no decoder of its own."""
    tokens = v.tokens
    return pa.array([" ".join(tokens[ids[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


def encode(docs: DataFrame, tokenizer_file: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; with `decoded`, also the text that these ids decode to, made in the
    same pass. The file's text goes to the workers: one tokenizer, a few MB."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(spec.value)
        texts = chunk.column(1).cast(pa.binary()).to_pylist()
        v.prepare({w for t in texts for w in t.split()})  # in one call, so that the merges run in batches
        blobs = [v.encode(t) for t in texts]
        at = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
        ids = np.frombuffer(b"".join(blobs), np.int32)
        columns = [chunk.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))]
        return pa.RecordBatch.from_arrays(columns + [texts_of(v, at, ids)] * decoded, ["doc_id", "ids"] + ["decoded"] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.chunk_rows(batches, work)

    rows = common.text_rows(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """Adds decoded, the text of ids, to stored rows (doc_id, ids)."""
    spec = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                col = batch.column(1)
                out = texts_of(v, np.asarray(col.offsets), np.asarray(col.values))
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    both = encode(docs, tokenizer_file, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
