"""BPE encoding and decoding by a tokenization automaton (operator 2).

The automaton reads tokens: its arcs bear labels of the vocabulary, and it accepts a
sequence of labels exactly if byte pair encoding would produce it. It is made by successive merge
gadgets. At first there is one state, and every base symbol is an arc from it to itself. The
gadget of the merge (u, v) then takes, for every way p -u-> q -v-> r:

* an arc p -uv-> r is added,
* q gets a copy that lacks the arc v, and p's arc u leads to the copy.

So after all gadgets the state behind an arc depends on its label alone ("after u"), and a state is
its ancestor's copy minus the arcs dropped since. Copies are kept as links to what was copied and the
rank at which it was, not as arcs written out (there would be billions): whether a state has an arc is
found by going back through the copies, and then stays in the transition table.

A string of symbols has one accepted sequence of labels, and so has each of its prefixes.
Encoding looks for the sequence accepted for the whole word, one table lookup per arc tried.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.common import give_back, table
from textrill.llm.units import TextEncoder, UnitTable, byte_batches

VOCABULARY = "word_bpe_49k.json"
TEXT_RUN = 1 << 19
DECODE_RUN = 1 << 16
MOST_ARCS = 1 << 18


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from
    U+0100 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in kept:
        out[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if b not in set(kept)):
        out[b] = chr(256 + n)
    return out


class Automaton:
    """The states and arcs of one merge list, and the table of the transitions used so far."""

    START = -1

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for label, i in vocab.items():
            self.labels[i] = label
        n = len(self.labels)
        self.born = [-1] * n  # the gadget that made the label, -1 for base symbols
        self.left, self.right = [-1] * n, [-1] * n
        self.dropped: dict[tuple[int, int], int] = {}  # (state, label) -> the gadget that dropped it
        self.arcs: list[dict[int, bool]] = []
        self.forget_arcs()
        # by character: what follows, the label that ends here inside a word, at a word's end
        self.root: dict[str, list] = {}
        live = [True] * n
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            live[w] = live[u] and live[v] and self._has(u, v, rank)
            self.left[w], self.right[w], self.born[w] = u, v, rank
            self.dropped[u, v] = rank
        for i, label in enumerate(self.labels):
            final = bool(suffix) and label.endswith(suffix)
            body = label[: -len(suffix)] if final else label
            if not body or not live[i] or self.born[i] < 0 and len(body) > 1:
                continue
            node = self.root
            for c in body[:-1]:
                node = node.setdefault(c, [{}, None, None])[0]
            entry = node.setdefault(body[-1], [{}, None, None])
            if final or not suffix:
                entry[2] = i
            if not final:
                entry[1] = i

    def _has(self, p: int, t: int, time: int) -> bool:
        """Whether the state behind ``p`` has the arc ``t``, counting gadgets before ``time``.

        The younger of the two is traced back: a state to what it was copied from, as of its
        making; an arc uv to the arc u that it was added beside, after that gadget's drop.
        """
        born, dropped = self.born, self.dropped
        while True:
            if dropped.get((p, t), time) < time:
                return False
            bp, bt = born[p], born[t]
            if bp == bt:
                if bp < 0:
                    return True
                p, t, time = self.right[p], self.left[t], bp
            elif bp > bt:
                p, time = self.right[p], bp
            else:
                t, time = self.left[t], bt + 1

    def forget_arcs(self) -> None:
        """Empty the table of the transitions used so far; it is filled again as words need them."""
        self.arcs, self.held = [{} for _ in range(len(self.born))], 0

    def encode(self, word: str) -> list[int]:
        """The labels of a word given as characters of the byte alphabet.

        From each position the longest arc is tried first. A prefix has one accepted sequence,
        so a position from which the end can't be reached needn't be reached again.
        """
        n, end, root, arcs_of = len(word), len(self.born), self.root, self.arcs
        if not n:
            return []
        if self.held > MOST_ARCS:
            self.forget_arcs()
            arcs_of = self.arcs
        path: list[int] = []
        trail: list[tuple[int, list]] = []
        dead: set[int] = set()
        i, p = 0, self.START
        while True:
            found, node = [], root  # the label of each length that matches at i, or None
            for c in word[i:]:
                entry = node.get(c)
                if entry is None:
                    break
                node, t, final = entry
                found.append(t)
            else:
                found[-1] = final
            while True:
                if not found:  # no arc leads on: back to the position before
                    dead.add(i)
                    if not trail:
                        raise ValueError(f"no label for a symbol of {word!r}")
                    path.pop()
                    i, found = trail.pop()
                    p = path[-1] if path else self.START
                    continue
                t = found.pop()
                if t is None:
                    continue
                j = i + len(found) + 1
                if dead and j in dead:
                    continue
                if p >= 0:
                    has = arcs_of[p].get(t)
                    if has is None:
                        has = arcs_of[p][t] = self._has(p, t, end)
                        self.held += 1
                    if not has:
                        continue
                path.append(t)
                if j == n:
                    return path
                trail.append((i, found))
                i, p = j, t
                break


class Codec:
    """Encoding and decoding as a tokenizer file says: special strings, NFC, lower case, words, bytes."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # fixed values

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("only plain BPE models are read")
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or spec["decoder"]:
            raise ValueError("only files with NFC, blanks replaced, lower case, split words and no decoder are read")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.labels = {i: label for label, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: s for s, i in special.items()}
        self.alphabet = byte_alphabet()
        self.units = UnitTable(self._learn)
        self.texts = TextEncoder(special, self.units, lower=True)

    def words(self, unit: str) -> list[str]:
        """The words of a unit: NFC, each character lower-cased by itself, split."""
        if unit.isascii():
            return self.WORDS.findall(unit.lower())
        return self.WORDS.findall("".join(map(str.lower, unicodedata.normalize("NFC", unit))))

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        alphabet, encode = self.alphabet, self.automaton.encode
        ids: list[int] = []
        ends = [0]
        for unit in new:
            for word in self.words(unit.decode()):
                ids += encode("".join([alphabet[b] for b in word.encode()]))
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(ends)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the last's end)."""
        return self.texts.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        """The arcs' labels, one after the other, with a blank between as the file has no decoder."""
        return " ".join(map(self.labels.__getitem__, ids.tolist()))

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ``ids``, each from its place in ``at`` to the next, as one column."""
        out, ends = bytearray(), [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for i in range(a, b, DECODE_RUN):
                out += b" " * (i > a) + self.decode(ids[i : min(b, i + DECODE_RUN)]).encode()
            ends.append(len(out))
        if len(out) >= 1 << 31:
            raise ValueError("the decoded texts of one run exceed 2 GB, the most that a column of strings holds")
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(np.array(ends, "<i4")), pa.py_buffer(out)])

    def release(self) -> None:
        """Give back what was kept of the texts seen."""
        self.units.clear()
        self.automaton.forget_arcs()


_codecs: dict[int, Codec] = {}


def codec_of(file_text: str) -> Codec:
    """One codec per file and Python worker: compiling takes about half a second."""
    key = hash(file_text)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(file_text)
    return _codecs[key]


def text_batches(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in runs of about ``size`` characters, with the row each begins at."""
    texts, held, begun = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= size or i + 1 == batch.num_rows:
            yield begun, texts
            texts, held, begun = [], 0, i + 1


def coded_batches(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, ids, decoded)`` of batches ``(doc_id, text)``; at the end the codec gives its tables back."""
    for batch in batches:
        for begin, texts in byte_batches(batch, 1, TEXT_RUN):
            ids, at = codec.encode(texts)
            texts.clear()
            n = len(at) - 1
            data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
            lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype("<i4")), data])
            decoded = codec.decode_all(ids, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), lists, decoded], ["doc_id", "ids", "decoded"])
    codec.release()
    give_back()


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: ids as little-endian unsigned 32-bit integers in a binary.

    Whole texts, row by row: a null or empty text has no ids and decodes to an empty text,
    repeated rows stay, an empty table gives none, other columns aren't read. A long text is encoded in
    pieces of half a megabyte that end where a word does; one word longer than that is encoded whole. What a worker
    keeps of the texts it has seen is bounded in bytes and given back at the end of each task. ``path`` names the
    vocabulary file, read by the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))  # a file of a set size
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return coded_batches(codec_of(shared.value), batches)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")


def vocabulary_text(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        return file.read()


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their decoding, as digests."""
    return digests(encode_decode(table(spark, sf_dir, "documents")))
