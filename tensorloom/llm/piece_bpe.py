"""SentencePiece BPE encoding by backtracking, and decoding.

A token sequence is the merge result of its text if every token is the merge
result of its own text and every two neighbours are that of theirs. So a
segment is covered from the left with the longest vocabulary match (all matches
come from one Aho-Corasick pass), each next token is checked against its left
neighbour by merging the two texts again (memoised per pair), and on failure
the search steps back to the next shorter match. A bit field marks positions
from which the rest cannot be covered, so no position fails twice.

Segments: a text is cut where no vocabulary piece joins the two characters;
no merge can cross such a place, so the cut is exact. Encodings of segments are
kept in a bounded table, since words repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import pick, whole_texts

SPACE = "▁"
#: Segments in a generation of a worker's table. A full generation becomes the old one, whose
#: entries come back when they are used again, so frequent words stay and memory is bounded.
TABLE_ENTRIES = 200_000
#: Longer segments are not kept.
TABLE_CHARS = 48


#: Pairs of tokens whose fit a worker keeps.
PAIR_ENTRIES = 200_000
#: Between ids joined by commas and the text that they decode to, where that is not simply the segment's own.
ODD = "\0"


class PieceBpe:
    """Encoder and decoder of one SentencePiece BPE model file."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL]
        bytes_ = [i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE]
        odd = [p.piece for p in proto.pieces if p.type in (kind.USER_DEFINED, kind.UNUSED)]
        if proto.trainer_spec.model_type != 2 or len(bytes_) != 256 or odd or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
        self.ids = {p.piece: i for i, p in plain}
        self.scores = {p.piece: p.score for _, p in plain}
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_ids = bytes_
        self.byte_of = {i: b for b, i in enumerate(bytes_)}
        self.joined = {p.piece[k : k + 2] for _, p in plain for k in range(len(p.piece) - 1)}
        # Pieces that merging their own text does not give can stand nowhere.
        self.alone = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.machine = ahocorasick.Automaton()
        for piece in sorted(self.alone):
            self.machine.add_word(piece, len(piece))
        self.machine.make_automaton()
        # A segment starts at a run of spaces; pieces that join a letter and a following space would forbid that.
        if any(a != SPACE and b == SPACE for a, b in self.joined):
            raise ValueError("pieces that reach over the end of a word are not supported")
        self._words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._fits: dict[tuple[str, str], bool] = {}
        self._named = {p: p for p in self.alone}
        self._table: dict[str, str] = {}
        self._old: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """The merge process itself: best score first, leftmost among equals. Used on one or two tokens' text."""
        parts, get, none = list(text), self.scores.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' text again gives these two tokens; memoised."""
        if len(self._fits) > PAIR_ENTRIES:
            self._fits.clear()
        # The vocabulary's own strings, so that keys share them.
        named = self._named.get
        known = self._fits[named(left, left), named(right, right)] = self.merged(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The tokens of one segment; characters outside the vocabulary are tokens of their own."""
        n = len(text)
        if n == 1 or text in self.alone:
            return [text]
        sizes: list[list[int]] = [[] for _ in range(n)]  # of the matches from each place, longest last
        for end, size in self.machine.iter(text):
            sizes[end - size + 1].append(size)
        known, failed, at = self._fits.get, bytearray(n // 8 + 1), 0  # failed, bit i: what follows place i cannot be covered
        tokens: list[str] = []
        left = None
        options = sizes[0] or [1]
        tried = [options]
        while True:
            if options:
                end = at + options.pop()
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                token = text[at:end]
                if left is not None:
                    fit = known((left, token))
                    if fit is False or fit is None and not self.fits(left, token):
                        continue
                tokens.append(token)
                if end == n:
                    return tokens
                left, at = token, end
                options = sizes[at] or [1]
                tried.append(options)
            else:
                if not tokens:
                    raise AssertionError(f"no tokenisation of {text!r}")
                failed[at >> 3] |= 1 << (at & 7)
                tried.pop()
                options = tried[-1]
                at -= len(tokens.pop())
                left = tokens[-1] if tokens else None

    def _part(self, part: str) -> str:
        """The ids of a stretch that no merge leaves, joined by commas; decoded once, to see that this gives the stretch back."""
        known, pieces = self.ids.get, self.pieces
        tokens = self.backtrack(part)
        ids = [known(token) for token in tokens]
        if None not in ids and "".join([pieces[i] for i in ids]) == part:
            return ",".join(map(str, ids))
        ids = [i for token, own in zip(tokens, ids) for i in ([own] if own is not None else [self.byte_ids[b] for b in token.encode("utf-8")])]
        decoded, joined = self._text(ids), ",".join(map(str, ids))
        return joined if decoded == part.replace(SPACE, " ") else f"{joined}{ODD}{decoded}"

    def _cut(self, word: str) -> str:
        """The same of a word with its leading spaces, cut where no piece joins two characters."""
        joined = self.joined
        cuts = [k for k, pair in enumerate(map(add, word, word[1:]), 1) if pair not in joined]
        if not cuts:
            return self._part(word)
        parts = [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]
        # A character of several bytes is one token, so bytes never decode across a cut.
        found = [self._kept(part, self._part) for part in parts]
        ids = ",".join(found)
        return ids if ODD not in ids else self._apart(parts, found)[0] + ODD + self._apart(parts, found)[1]

    @staticmethod
    def _apart(segments: list[str], found: list[str]) -> tuple[str, str]:
        """(ids, decoded text) of segments some of which decode to another text than their own."""
        pairs = [f.partition(ODD) for f in found]
        return ",".join([ids for ids, _, _ in pairs]), "".join([text if odd else s.replace(SPACE, " ") for s, (_, odd, text) in zip(segments, pairs)])

    def _kept(self, text: str, make) -> str:
        """From the table, or made and put there; words and their stretches share it."""
        found = self._table.get(text)
        if found is None:
            found = self._old.get(text) or make(text)
            if len(text) <= TABLE_CHARS:
                if len(self._table) >= TABLE_ENTRIES:
                    self._old, self._table = self._table, {}
                self._table[text] = found
        return found

    def _text(self, ids: list[int]) -> str:
        pieces = self.pieces
        if not any(i in self.byte_of for i in ids):
            return "".join([pieces[i] for i in ids]).replace(SPACE, " ")
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def coded(self, text: str) -> tuple[int, str, str]:
        """(tokens, ids joined by commas, decoded text) of a whole text, through the table."""
        if not text:
            return 0, "", ""
        whole = SPACE + text.replace(" ", SPACE)
        words = self._words.findall(whole)
        get, kept, cut = self._table.get, self._kept, self._cut
        found = [get(word) or kept(word, cut) for word in words]
        ids, decoded = ",".join(found), whole.replace(SPACE, " ")
        if ODD in ids:
            ids, decoded = self._apart(words, found)
        return ids.count(",") + 1, ids, decoded[1:]

    def encode(self, text: str | None) -> list[int]:
        joined = self.coded(text or "")[1]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """The text of any ids of normal or byte pieces; the dummy prefix goes."""
        text = self._text(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else text


@lru_cache(maxsize=4)
def load(model_file: str) -> PieceBpe:
    """One coder per worker process and file; workers live through many tasks."""
    return PieceBpe(model_file)


def encode(docs: DataFrame, model_file: str, digest: bool = False) -> DataFrame:
    """Encode and decode every row's whole text.

    ``(doc_id, ids array<int>, decoded string)``, or with ``digest`` their count
    and hashes ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``. Null and empty
    texts have no ids and decode to the empty text; repeated rows each get a row,
    a null doc_id stays null, other columns are ignored. Map-only: no shuffle.
    ``model_file`` must be readable on every executor, as installed packages are.
    """

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    names = [column.split()[0] for column in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model_file)
        for part in parts:
            counts, ids, decoded = [], [], []
            for text in part.column(1):
                for held, value in zip((counts, ids, decoded), coder.coded(text.as_py() or "")):
                    held.append(value)
            if digest:
                columns = [pa.array(counts, pa.int64()), pa.array([sha256(x.encode()).hexdigest() for x in ids]), pa.array([sha256(x.encode()).hexdigest() for x in decoded])]
            else:
                flat = np.fromstring(",".join([x for x in ids if x]), np.int32, sep=",")
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    rows = whole_texts(pick(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string")))
    return rows.mapInArrow(run, schema)
