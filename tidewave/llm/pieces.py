"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking.

A text's tokens are the one sequence in which every two neighbours survive re-merging: running the merges over the pair's
characters gives the pair back. So the encoder walks the text with the longest piece that starts at each place (found
with an Aho-Corasick automaton), steps to a shorter piece when the pair with the token before doesn't survive, and goes
back one token when none is left; a bit field marks places from which no way leads to the end, so none is tried twice.

Pieces never hold white space after another character, so a text falls into chunks (white space with the word after it,
cut at line feeds as well if no piece has one) that are encoded once per worker and remembered.

Defined results: null text counts as empty (begin and end ids, decoded to the empty text); null doc_id stays null;
repeated rows give repeated rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewave.llm._common import clean_ids, spread, table, text_pieces

MARK = "▁"
#: Chunks, and pairs of tokens, that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 400_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its vocabulary alone
        size = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in size]
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in size if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        special = {i for i in size if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.silent = {i for i in size if model.is_control(i)}
        self.id_of = {self.text[i]: i for i in size if i not in special}
        self.score = {self.text[i]: model.get_score(i) for i in size if i not in special}
        self.bos, self.eos, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            if len(piece) > 1 and self.merged(piece):  # merging makes it; single characters are always there
                self.automaton.add_word(piece, len(piece) - 1)
        self.automaton.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece has white space after another character")
        self.cuts_lines = not any("\n" in p for p in self.id_of)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # what the parts decode to whose own text differs from that

    def merged(self, text: str, edge: int = 0) -> bool:
        """Do the merges (the best score first, the leftmost of equals) end with one token, or two that meet at `edge`?"""
        get, none = self.score.get, -2e9
        parts, sizes = list(text), [1] * len(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            sizes[at] += sizes.pop(at + 1)
            if edge and sum(sizes[:at]) < edge < sum(sizes[: at + 1]):
                return False
            parts[at] += parts.pop(at + 1)
            scores.pop(at)
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], none)
        return len(parts) == 1 + (edge > 0)

    def survives(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right, len(left))
        return known

    def tokens(self, text: str) -> list[str]:
        """The tokens of a chunk by backtracking; a character without a piece is a token by itself."""
        n, survives = len(text), self.survives
        ends = [[i] for i in range(1, n + 1)]  # of the pieces that start at each place, the longest last
        for last, size in self.automaton.iter(text):
            ends[last - size].append(last + 1)
        failed = at = 0
        before = ""
        path: list[tuple[int, str, list[int]]] = []  # place, the token before it, the ends not yet tried
        left = ends[0]
        while at < n:
            while left:
                end = left.pop()
                token = text[at:end]
                if not failed >> end & 1 and (not before or survives(before, token)):
                    path.append((at, before, left))
                    at, before = end, token
                    left = ends[at].copy() if at < n else left
                    break
            else:
                failed |= 1 << at
                at, before, left = path.pop()
        return [x[1] for x in path[1:]] + [before]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(text):
            i = self.id_of.get(token)
            if i is not None:
                out.append(i)
            elif self.id_of_byte:
                out += [self.id_of_byte[b] for b in token.encode("utf-8")]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids that don't begin a text: pieces with spaces for marks, runs of byte pieces as UTF-8."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.silent:
                out.append(self.text[i].replace(MARK, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def part(self, part: str, spaces: int = 1) -> tuple[bytes, str]:
        """Ids and their text of what stands between two marks, with so many marks before it.

        A part that begins with a line feed has no mark of its own before it.
        """
        if part[:1] == "\n" and self.cuts_lines:
            runs = [MARK * (spaces - 1), "\n", part[1:]]
        else:
            runs = [MARK * spaces + part]
        ids = [i for run in runs if run for i in self.ids(run)]
        return np.asarray(ids, "<u4").tobytes(), self.decode(ids)

    def learn(self, part: str) -> bytes:
        known = self.old.get(part)
        if known is None:
            known, text = self.part(part)
            if text != (part if part[0] == "\n" and self.cuts_lines else " " + part):
                self.odd[part] = text
        if len(self.young) > REMEMBERED:
            self.old, self.young, self.odd = self.young, {}, {k: v for k, v in self.odd.items() if k in self.young}
        self.young[part] = known
        return known

    def __call__(self, text: str) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits each, with begin and end) and the text that they decode to."""
        bos, eos = np.asarray([self.bos], "<u4").tobytes(), np.asarray([self.eos], "<u4").tobytes()
        if not text:
            return bos + eos, ""
        marked = text.replace(" ", MARK)
        parts = (marked.replace("\n", MARK + "\n") if self.cuts_lines else marked).split(MARK)
        if "" not in parts and parts[0][0] != "\n":
            get = self.young.get
            found = [get(x) or self.learn(x) for x in parts]
            if self.odd.keys().isdisjoint(parts):
                return bos + b"".join(found) + eos, text.replace(MARK, " ")
            said = "".join([self.odd.get(x) or (x if x[0] == "\n" and self.cuts_lines else " " + x) for x in parts])
            return bos + b"".join(found) + eos, said[1:]
        found, said, spaces = [], [], 1
        if parts[0][:1] == "\n" and self.cuts_lines:
            spaces = 2  # the mark that begins every text stands alone
        for part in parts:
            if part and spaces == 1:
                found.append(self.young.get(part) or self.learn(part))
                said.append(self.odd.get(part) or (part if part[0] == "\n" and self.cuts_lines else " " + part))
            elif part:
                ids, own = self.part(part, spaces)
                found.append(ids)
                said.append(own)
                spaces = 1
            else:
                spaces += 1
        if spaces > 1:
            ids = self.ids(MARK * (spaces - 1))
            found.append(np.asarray(ids, "<u4").tobytes())
            said.append(self.decode(ids))
        return bos + b"".join(found) + eos, "".join(said)[1:]


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_decode(docs: DataFrame, model: str | None = None, keep: bool = True) -> DataFrame:
    """Each document's ids and the text they decode to (keep=False: their digests alone)."""
    path = model or default_model()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep]

    def run(batches):
        code = coder(path)
        for part in text_pieces(batches):
            rows = [code(x) for x in part.column("text").to_pylist()]
            columns = [part.column("doc_id"), pa.array([len(a) // 4 for a, _ in rows], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a, _ in rows], pa.string()), pa.array([hashlib.sha256(b.encode("utf-8")).hexdigest() for _, b in rows], pa.string())]
            if keep:
                columns += [pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([b for _, b in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return spread(clean_ids(docs, "doc_id", "text")).mapInArrow(run, ENCODED + ", ids array<int>, decoded string" * keep)


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), keep=False)
