"""SentencePiece encoding and decoding with a weighted finite-state transducer."""

import re
import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import freed, kept, small_batches

SPACE = "▁"


EPSILON, OTHER = "", None  # labels: reads nothing; any character without an arc of its own, which is copied
INFINITE = float("inf")


class Fst:
    """A weighted transducer in the tropical semiring: for each state and input label its arcs (output, weight, next state)."""

    def __init__(self):
        self.arcs: list[dict] = [{}]

    def add(self, state: int, label: str | None, output, weight: float, to: int | None = None) -> int:
        """An arc, to a new state if to is None; returns the state that it leads to."""
        if to is None:
            to = len(self.arcs)
            self.arcs.append({})
        self.arcs[state].setdefault(label, []).append((output, weight, to))
        return to


def normaliser() -> Fst:
    """State 0 puts SPACE before the text; state 1 turns each space into SPACE and copies other characters. All weights are 0."""
    n = Fst()
    n.add(0, EPSILON, SPACE, 0.0)
    n.add(1, " ", SPACE, 0.0, 1)
    n.add(1, OTHER, OTHER, 0.0, 1)
    return n


def segmenter(pieces: list[str]) -> Fst:
    """From state 0 along the characters of each piece, and back to 0 with the piece as output, at a weight of 1.

    Byte fallback: from state 0 any character that is no piece goes back to 0 with itself as output, at a weight of 1 for each
    byte of its UTF-8 (OTHER stands for all of them; its weight here is that of the first byte).
    """
    s, at = Fst(), {"": 0}
    for x in sorted(pieces):
        for k in range(1, len(x) + 1):
            if x[:k] not in at:
                at[x[:k]] = s.add(at[x[: k - 1]], x[k - 1], EPSILON, 0.0)
        s.add(at[x], EPSILON, x, 1.0, 0)
    s.add(0, OTHER, OTHER, 1.0, 0)
    return s


#: For pieces of which nothing is known yet.
NONE: dict[str, float] = {}


class Transducer:
    """The composition of normaliser, segmenter into pieces with byte fallback, and neighbours, for BPE models without a character map.

    Neighbours: an acceptor whose state is the piece last emitted. In BPE, two pieces are only right side by side if merging their
    characters yields just these two; its arc from a to b has weight 0 if so and infinity otherwise. Each piece costs 1 (a byte of
    the fallback too). A text goes through the composition of the three, which is made state by state as the text needs it,
    and takes the path of least total weight. By the way merges are ordered, one path is of finite weight: the BPE's result.
    """

    def __init__(self, model: str):
        import sentencepiece as sp

        p = sp.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.bytes_ = {int(x[3:5], 16): i for i, x in enumerate(self.pieces) if p.is_byte(i)}
        normal = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.score = {self.pieces[i]: p.get_score(i) for i in normal}
        self.ids = {self.pieces[i]: i for i in normal}
        self.normaliser, arcs_of = normaliser(), segmenter(list(self.ids)).arcs
        # states that are never left and copy what has no arc: their output by character
        self.loops = [{ord(c): output for c, ((output, _, _),) in arcs.items() if c} if OTHER in arcs and EPSILON not in arcs and all(to == k for ((_, _, to),) in arcs.values()) and arcs[OTHER][0][0] is OTHER else None for k, arcs in enumerate(self.normaliser.arcs)]
        # the segmenter's states for quick steps: (next states by character or None, piece that ends here or None, its weight)
        nodes: list[tuple[dict | None, str | None, float]] = [({} if len(arcs) > (EPSILON in arcs) else None, *next(((x, w) for x, w, _ in arcs.get(EPSILON, ())), (None, 0.0))) for arcs in arcs_of]
        for (onward, *_), arcs in zip(nodes, arcs_of, strict=True):
            if onward is not None:
                onward.update({c: nodes[to] for c, ((_, _, to),) in arcs.items() if c not in (EPSILON, OTHER)})
        self.start = nodes[0][0]
        self.longest = max(map(len, self.ids))
        # neighbouring characters that no piece holds side by side: the composition falls apart there
        inside = {x[k : k + 2] for x in self.ids for k in range(len(x) - 1)}
        self.inside = inside
        # SPACE never follows another character within a piece, so words are composed on their own
        self.apart = not any(x.endswith(SPACE) and x[0] != SPACE for x in inside)
        # nor does a letter stand beside another character; letters that do in this model count as others
        pairs, letters = [x for x in inside if SPACE not in x], {c for x in inside for c in x if c.isalpha()}
        while mixed := {c for x in pairs if (x[0] in letters) != (x[1] in letters) for c in x} & letters:
            letters -= mixed
        letter = "".join(map(re.escape, sorted(letters)))
        self.stretches = re.compile(f" ?[{letter}]+| ?[^ {letter}]+| " if letter else " ?[^ ]+| ").findall
        self.alone: dict[str, bool] = {}
        self.beside: dict[str, dict[str, float]] = {}
        self.sides = 0
        self.words: dict[str, tuple[int, ...]] = {}  # those of late, and those before them
        self.older: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.back = {i: b for b, i in self.bytes_.items()}

    def merged(self, text: str) -> list[str]:
        """Merging by definition: the neighbours of best score, the first of equals, until no two form a piece."""
        parts = list(text)
        while True:
            found = [(-self.score[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def neighbours(self, a: str, b: str) -> float:
        """The weight of the arc from piece a ("": the start) to piece b."""
        after = self.beside.setdefault(a, {})
        if (weight := after.get(b)) is None:
            if self.sides > 400_000:
                self.forget()
                after = self.beside.setdefault(a, {})
            if (own := self.alone.get(b)) is None:
                own = self.alone[b] = self.merged(b) == [b]
            weight = after[b] = 0.0 if own and (not a or self.side_by_side(a, b)) else INFINITE
            self.sides += 1
        return weight

    def forget(self) -> None:
        """Drops what is known of pieces side by side."""
        self.beside.clear()
        self.sides = 0

    def side_by_side(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: no merge on the way crosses the place between them."""
        score, parts, edge = self.score.get, list(a + b), len(a)
        rank = [score(x + y, None) for x, y in zip(parts[:-1], parts[1:], strict=True)]
        while len(parts) > 2:
            best, k = None, 0
            for j, r in enumerate(rank):
                if r is not None and (best is None or r > best):
                    best, k = r, j
            if best is None or k == edge - 1:
                return False
            if k < edge:
                edge -= 1
            parts[k] += parts.pop(k + 1)
            rank.pop(k)
            if k:
                rank[k - 1] = score(parts[k - 1] + parts[k], None)
            if k < len(rank):
                rank[k] = score(parts[k] + parts[k + 1], None)
        return rank[0] is None

    def path(self, text: str) -> list[str]:
        """The shortest path of segmenter and neighbours for normalised text: the pieces (or single characters, for the fallback).

        States of the composition that read nothing are (position, last piece). They are taken in order of weight plus the least that
        can follow, a piece for every so many characters as the longest has, the farthest of equals first. From each, the segmenter's
        arcs are followed through the text and back to its state 0; a state that is reached keeps the least weight and where it
        came from. The first state taken at the end of the text has the least weight of all.
        """
        n, root, beside, longest = len(text), self.start, self.beside, self.longest
        least: dict[tuple[int, str], float] = {}
        best: dict[tuple[int, str], tuple[int, str]] = {}
        waiting, at, a, before = [], 0, "", 0.0
        while at < n:
            after = beside.get(a, NONE)
            onward, end, b = root, at, text[at]
            node = onward.get(b)
            if node is None or node[1] is None:
                onward, weight, end = node and node[0], float(len(b.encode("utf-8", "replace"))), at + 1
            else:
                onward, b, weight = node
                end += 1
            while True:
                if b is not None:
                    beyond = after.get(b)
                    if beyond is None:
                        beyond, after = self.neighbours(a, b), beside[a]
                    if beyond < INFINITE:
                        total = before + weight + beyond
                        state = (end, b)
                        if total < least.get(state, INFINITE):
                            least[state] = total
                            best[state] = (at, a)
                            heappush(waiting, (total - (end - n) // longest, -end, b, total))
                if not onward or end == n or (node := onward.get(text[end])) is None:
                    break
                onward, b, weight = node
                end += 1
            _, at, a, before = heappop(waiting)
            at = -at
        out = []
        while at:
            out.append(a)
            at, a = best[at, a]
        return out[::-1]

    def normal(self, text: str, state: int) -> str:
        """The output of the normaliser for text, from one of its states."""
        arcs, out = self.normaliser.arcs, []
        while EPSILON in arcs[state]:
            output, _, state = arcs[state][EPSILON][0]
            out.append(output)
        other = arcs[state].get(OTHER)
        if (same := self.loops[state]) is not None:
            return "".join(out) + text.translate(same)
        for c in text:
            (output, _, to), = arcs[state].get(c, other)
            if to != state:
                state, other = to, arcs[to][OTHER]
            out.append(c if output is OTHER else output)
        return "".join(out)

    def split(self, text: str) -> list[str]:
        """text cut wherever no piece could cross."""
        inside = self.inside
        edges = [k for k, x in enumerate(map("".join, zip(text, text[1:])), 1) if x not in inside]
        if not edges:
            return [text]
        edges = [0, *edges, len(text)]
        return [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def composed(self, text: str, state: int) -> tuple[int, ...]:
        """The ids of a stretch of text, the normaliser being in a state. A long one is cut where no piece crosses."""
        text = self.normal(text, state)
        if len(text) <= 24:
            return self.ids_of(text)
        out: list[int] = []
        for part in self.split(text):
            found = self.parts.get(part)
            if found is None:
                found = self.ids_of(part)
                if len(part) < 64:
                    self.parts[part] = found
            out += found
        return tuple(out)

    def ids_of(self, part: str) -> tuple[int, ...]:
        """The output of the shortest path: ids of pieces, or of the bytes of what is none."""
        out, ids = [], self.ids
        for p in self.path(part):
            if p in ids:
                out.append(ids[p])
            else:
                out += [self.bytes_[b] for b in p.encode("utf-8", "replace")]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a text. Where no piece can cross from a word to the next, each distinct word is composed once."""
        if not text:
            return []
        if len(self.parts) > 100_000:
            self.parts.clear()
        if not self.apart or SPACE in text or "\0" in text or "  " in text or text[0] == " ":
            return list(self.composed(text, 0))
        first, *words = text.replace(" ", "\0 ").split("\0")
        out = list(self.composed(first, 0))
        for word in words:
            ids = self.words.get(word)
            out += self.word(word) if ids is None else ids
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of a word after the first that is not among those of late. Its stretches of letters and of others are composed on their own."""
        ids = self.older.get(word)
        if ids is None:
            stretches = self.stretches(word)
            if len(stretches) < 2:
                ids = self.composed(word, 1)
            else:
                ids = tuple([i for x in stretches for i in self.words.get(x) or self.word(x)])
        if len(word) < 32:
            if len(self.words) >= 500_000:
                self.words, self.older = {}, self.words
            self.words[word] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The output side reversed: pieces to characters, runs of byte pieces to UTF-8, SPACE to a space, the first one dropped."""
        pieces, back = self.pieces, self.back
        if back.keys().isdisjoint(ids):
            return "".join([pieces[i] for i in ids]).replace(SPACE, " ")[1:]
        data = b"".join(bytes([back[i]]) if i in back else pieces[i].encode() for i in ids)
        return data.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def encode_documents(docs: DataFrame, model: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_crc32, round_trip) and ids, those of the pieces, of docs (doc_id, text).

    ids_crc32: of the ids as little-endian unsigned 32-bit integers. round_trip: whether decoding gives the text again, but for SPACE
    characters in it, which become spaces. A null or empty text has no pieces; very long texts are encoded whole. Rows are independent: rows
    that repeat a doc_id, or have none, get a row each. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """

    def run(batches):
        t = kept(("wfst", model), lambda: Transducer(model))
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            coded = [t.encode(x) for x in texts]
            same = [t.decode(i) == x.replace(SPACE, " ") for x, i in zip(texts, coded, strict=True)]
            crc = [zlib.crc32(np.array(i, "<u4").tobytes()) for i in coded]
            columns = [b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(len, coded), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
            names = ["doc_id", "n_chars", "n_pieces", "ids_crc32", "round_trip"]
            if ids:
                columns.append(pa.array(coded, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        t.parts.clear()  # the worker keeps the transducer, its neighbours and words of late

    small_batches(docs.sparkSession)
    kind = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), kind)


def piece_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids, by the public model of 32,000 pieces: the columns of encode_documents(), not those of docs.

    Rows that repeat a doc_id get a row each, and so do those without one or without text; an empty table gives an empty result.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
