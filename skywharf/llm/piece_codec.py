"""Encoding and decoding with a merge-type piece vocabulary, by a score-ordered agenda of adjacent symbol pairs.

A text begins as its characters. Every adjacent pair that makes a piece of the vocabulary waits in an agenda; the pair of
the best score, the leftmost of equal ones, is merged, and the pairs that the new symbol makes with its neighbours join
the agenda. Short parts of a text go through it many at a time, in arrays; a long one has a heap. Two characters that stand next to each other in no piece can never be joined, so a text falls apart between
them into parts that do not influence each other, and a task encodes each distinct part once. Arrow batches carry
the texts; the sentencepiece library checks each batch.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from skywharf.llm.rows import text_batches
from skywharf.llm.words import bounded

#: What stands for a space inside pieces, and the kinds of pieces in a model file (fixed values of the file format).
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
#: What the library writes for an unknown id and for bytes that are no character.
UNKNOWN_TEXT, REPLACEMENT = " ⁇ ", "�"
#: Distinct parts that a task keeps encoded, and the longest one kept. Others are encoded each time they come.
KEPT_PARTS, KEPT_CHARS = 500_000, 64
BATCH_BYTES = 1_000_000
_BASE, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Vocabulary:
    """Pieces of a merge-type model with byte fallback, whose texts are taken as they are behind one space."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules, trained = proto.normalizer_spec, proto.trainer_spec
        kinds = {piece.type for piece in proto.pieces}
        if trained.model_type != MERGES or not trained.byte_fallback or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only merge-type models with byte fallback, without user-defined or unused pieces, are supported")
        if rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only models that take texts as they are, behind one space, are supported")
        self.model = model
        self.pieces = [(piece.piece, piece.type) for piece in proto.pieces]
        #: The smallest cost is merged first.
        self.costs = {piece.piece: -piece.score for piece in proto.pieces if piece.type == NORMAL}
        self.ids = {piece.piece: k for k, piece in enumerate(proto.pieces) if piece.type == NORMAL}
        self.bytes = {int(piece.piece[1:-1], 16): k for k, piece in enumerate(proto.pieces) if piece.type == BYTE}

    @cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each character (0: in no longer piece), and whether two numbers stand next to each other in a piece."""
        pairs = {piece[k : k + 2] for piece in self.costs for k in range(len(piece) - 1)}
        numbers = {c: k for k, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
        of = np.zeros(0x110000, dtype=np.int32)
        together = np.zeros((len(numbers) + 1, len(numbers) + 1), dtype=bool)
        for c, k in numbers.items():
            of[ord(c)] = k
        for a, b in pairs:
            together[numbers[a], numbers[b]] = True
        return of, together

    def cut(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Number of each part of the texts end to end, the distinct parts, and the offsets of the texts.

        A text stands behind one space and is cut where two characters stand next to each other in no piece. Parts are
        told apart by 64-bit hashes, taken as differences of running sums, so only distinct ones are made strings.
        """
        of, together = self.joined
        spaced = [SPACE + text.replace(" ", SPACE) if text else "" for text in texts]
        whole = "".join(spaced)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begins = np.cumsum([0, *map(len, spaced)])
        number = of[codes]
        cut = np.ones(len(codes) + 1, dtype=bool)
        cut[1:-1] = ~together[number[:-1], number[1:]]
        cut[begins] = True
        cuts = np.flatnonzero(cut)
        powers = np.cumprod(np.full(len(codes), _BASE)) * _UNDO
        sums = np.append(np.uint64(0), np.cumsum((codes + np.uint64(1)) * _SPREAD * powers))
        sizes = np.diff(cuts)
        hashed = (sums[cuts[1:]] - sums[cuts[:-1]]) * np.cumprod(np.full(len(codes) + 1, _UNDO))[cuts[:-1]]
        which, found = pd.factorize(hashed ^ sizes.astype(np.uint64) * _SPREAD)
        first = np.full(len(found), len(which), dtype=np.int64)
        np.minimum.at(first, which, np.arange(len(which)))
        return which, [whole[a:b] for a, b in zip(cuts[first].tolist(), cuts[first + 1].tolist())], np.searchsorted(cuts, begins)

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]], int]:
        """Pairs of symbols that make a piece, as sorted numbers, with the rank of the piece's cost and its symbol; the ids of each symbol; the number of symbols."""
        of, _ = self.joined
        names = ["", *(chr(c) for c in np.flatnonzero(of)[np.argsort(of[of > 0])]), *(x for x in self.costs if len(x) > 1)]
        symbol = {name: k for k, name in enumerate(names)}
        rank = {cost: k for k, cost in enumerate(sorted(set(self.costs.values())))}
        rows = sorted(
            (symbol[piece[:k]] * len(names) + symbol[piece[k:]], rank[cost], symbol[piece])
            for piece, cost in self.costs.items() for k in range(1, len(piece)) if piece[:k] in symbol and piece[k:] in symbol
        )
        pairs, ranks, made = (np.array(x, dtype=np.int64) for x in zip(*rows))
        return pairs, ranks, made, [self.ids_of_symbol(name) for name in names], len(names)

    def ids_of_parts(self, parts: list[str]) -> list[list[int]]:
        """``ids_of_part`` of many short parts at once: in each round every part merges the best pair of its agenda."""
        pairs, ranks, made, ids, count = self.merges
        none = np.int64(1) << 62
        symbols = self.joined[0][np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        done_symbols, done_owner = [], []
        while len(symbols):
            pair = symbols[:-1] * count + symbols[1:]
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            fits = (pairs[at] == pair) & (owner[:-1] == owner[1:])
            # The smallest cost goes first, the leftmost of equal ones.
            offered = np.append(np.where(fits, ranks[at] << 32 | np.arange(len(pair)), none), none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(offered, first)
            sizes = np.diff(np.append(first, len(symbols)))
            active = np.repeat(best < none, sizes)
            done_symbols.append(symbols[~active])
            done_owner.append(owner[~active])
            left = best[best < none] & 0xFFFFFFFF
            symbols[left] = made[at[left]]
            active[left + 1] = False
            symbols, owner = symbols[active], owner[active]
        owner = np.concatenate(done_owner) if done_owner else np.empty(0, dtype=np.int64)
        by = np.argsort(owner, kind="stable")
        flat = np.concatenate(done_symbols)[by].tolist() if done_symbols else []
        cuts = np.searchsorted(owner[by], np.arange(len(parts) + 1)).tolist()
        return [[i for k in flat[a:b] for i in ids[k]] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str], known: dict[str, list[int]] | None = None) -> list[list[int]]:
        """Ids of each text, without begin and end; ``known`` keeps the ids of short parts."""
        known = {} if known is None else known
        which, parts, offsets = self.cut(texts)
        if len(known) + len(parts) > KEPT_PARTS:
            known.clear()
        short = [part for part in parts if part not in known and 1 < len(part) <= KEPT_CHARS]
        known.update(zip(short, self.ids_of_parts(short)))
        made = [known[part] if part in known else self.ids_of_part(part) for part in parts]
        sizes = np.array([len(x) for x in made], dtype=np.int64)
        flat = np.array([i for x in made for i in x], dtype=np.int64)
        own = sizes[which]
        ends = np.append(0, np.cumsum(own))
        # Place in ``flat`` of each id: that of its part, and on from there.
        place = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], own)
        ids = flat[place].tolist()
        at = ends[offsets].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    @cached_property
    def plain(self) -> list[str | None]:
        """What an id says wherever it stands: pieces and bytes that are a character. None for all others."""
        said = {NORMAL: lambda piece: piece.replace(SPACE, " "), BYTE: lambda piece: chr(int(piece[1:-1], 16)) if int(piece[1:-1], 16) < 0x80 else None}
        return [said[kind](piece) if kind in said else None for piece, kind in self.pieces]

    def merged(self, part: str) -> list[str]:
        """Symbols of a part of a text after all merges."""
        symbols, cost, count = list(part), self.costs.get, len(part)
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        agenda = [(c, k, k + 1, 2) for k in range(count - 1) if (c := cost(part[k : k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            first, second = symbols[left], symbols[right]
            # An entry is stale when one of its symbols was merged since.
            if not first or not second or len(first) + len(second) != size:
                continue
            symbols[left], symbols[right] = first + second, ""
            following, previous = after[right], before[left]
            after[left] = following
            if following >= 0:
                before[following] = left
                pair = symbols[left] + symbols[following]
                if (c := cost(pair)) is not None:
                    heapq.heappush(agenda, (c, left, following, len(pair)))
            if previous >= 0:
                pair = symbols[previous] + symbols[left]
                if (c := cost(pair)) is not None:
                    heapq.heappush(agenda, (c, previous, left, len(pair)))
        return [s for s in symbols if s]

    def ids_of_symbol(self, symbol: str) -> list[int]:
        own = self.ids.get(symbol)
        return [own] if own is not None else [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def ids_of_part(self, part: str) -> list[int]:
        return [i for symbol in self.merged(part) for i in self.ids_of_symbol(symbol)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: one leading space goes, control pieces are silent, bytes that make no character become a mark each."""
        plain = [self.plain[i] for i in ids]
        if None not in plain:
            return "".join(plain)[1 if ids and self.pieces[ids[0]][0].startswith(SPACE) else 0 :]
        out: list[str] = []
        waiting = bytearray()
        # The space that encoding puts before a text stands in its first piece; only there it is taken away.
        leading = True
        for i in ids:
            piece, kind = self.pieces[i]
            if kind == BYTE:
                waiting.append(int(piece[1:-1], 16))
                continue
            if waiting:
                out.append(characters(bytes(waiting)))
                waiting.clear()
                leading = False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(UNKNOWN_TEXT)
                leading = False
                continue
            if leading and piece.startswith(SPACE):
                piece = piece[1:]
                leading = False
            leading = leading and not piece
            out.append(piece.replace(SPACE, " "))
        out.append(characters(bytes(waiting)))
        return "".join(out)


def characters(data: bytes) -> str:
    """UTF-8 text of bytes, with one mark for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            out.append(data[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append(REPLACEMENT)
            at += 1
    return "".join(out)


def encode(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """doc_id, ids (array), decoded and agrees of every row of ``docs`` (doc_id, text), with the model file ``model``.

    ``decoded`` is the text that the ids give; ``agrees`` tells whether the library gives the same ids and the same text
    for them, null without ``check``. A null or empty text has no ids and an empty ``decoded``; repeated rows are encoded
    one by one; other columns are ignored; an empty table gives an empty result. A text is encoded whole.
    """
    return _each(docs, model, check, "ids array<int>, decoded string", {
        "ids": lambda text, ids, decoded: ids, "decoded": lambda text, ids, decoded: decoded,
    }, [pa.list_(pa.int32()), pa.string()])


def digests(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and agrees, as ``encode`` without the arrays: nothing large leaves a task."""

    def sha(value: str) -> str:
        return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()

    decimal: list[str] = []

    def joined(ids: list[int]) -> str:
        while ids and len(decimal) <= max(ids):
            decimal.append(str(len(decimal)))
        return ",".join([decimal[i] for i in ids])

    return _each(docs, model, check, "n_tokens long, ids_sha256 string, decoded_sha256 string", {
        "n_tokens": lambda text, ids, decoded: len(ids), "ids_sha256": lambda text, ids, decoded: sha(joined(ids)),
        "decoded_sha256": lambda text, ids, decoded: sha(decoded),
    }, [pa.int64(), pa.string(), pa.string()])


def _each(docs: DataFrame, model: bytes, check: bool, schema: str, columns: dict, types: list) -> DataFrame:
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        known: dict[str, list[int]] = {}
        library = None
        if check:
            from sentencepiece import SentencePieceProcessor

            library = SentencePieceProcessor(model_proto=shared.value)

        for batch in bounded(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = vocabulary.encode(texts, known)
            decoded = [vocabulary.decode(own) for own in ids]
            agrees = [None] * len(texts)
            if library:
                theirs = library.encode(texts, num_threads=1)
                agrees = [a == b and c == d for a, b, c, d in zip(ids, theirs, decoded, library.decode(theirs, num_threads=1))]
            made = [pa.array([make(*x) for x in zip(texts, ids, decoded)], t) for make, t in zip(columns.values(), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, pa.array(agrees, pa.bool_())], ["doc_id", *columns, "agrees"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}, agrees boolean")
