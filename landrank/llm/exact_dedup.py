"""Operator 5: exact dedup by owners in Patricia tries.

Texts are equal when identical after white space is deleted.  Rows are dealt by length and content hash of the
normalised bytes; each part inserts whole byte strings into compressed radix tries, whose terminal nodes hold the owner:
most code points in the original text, then smallest doc_id (null last), then smallest row number.  Equality is thus
decided on the bytes themselves, never on a digest.

Skew.  Every Arrow batch first runs its own small trie, so that of equal texts one row a batch travels (of ``survivors``,
few a task: its trie goes on over the batches); a text that a third of all rows share reaches its part as these, and streams
through it: a part is sorted by length, hash
and order of preference (Spark's sort spills), so the first row of a text is its owner, nothing of a group is gathered,
and the trie of one length and hash is dropped before the next begins.  Should different texts meet under one length and
hash, and outgrow ``TRIE_BYTES``, the largest subtrees go to unnamed scratch files of the task, which take all later rows
of theirs and are merged at the end, one at a time.

Cases.  Null text counts as empty.  Empty and all-space texts are equal to each other.  Rows repeated in full: the
first numbered one stays.  Null doc_id: sorts after all others, is kept in the result.  Empty table: empty result.
Extra columns, whatever their names: ``membership`` ignores them, ``survivors`` hands them on.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_pass, carried, field_of, handed_on, stored

#: Bytes of labels that one trie keeps in memory.
TRIE_BYTES = 64 << 20
#: Bytes of labels that a task keeps to leave out copies before the shuffle.
THIN_BYTES = 16 << 20
DELETED = SPACES.encode()


def preference(row):
    """Sorts owners: row is (code points, doc_id or None, row number, ...)."""
    return (-row[0], row[1] is None, row[1] or 0, row[2])


class Node:
    __slots__ = ("label", "kids", "owner")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner = label, {}, None


class PatriciaTrie:
    """Whole byte strings in a compressed radix trie; the terminal node of a string holds the row that owns it."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.root, self.limit, self.held, self.spilled = Node(b""), limit, 0, {}

    def place(self, key: bytes, row):
        """The owner of ``key`` so far, ``row`` included; None where the key's subtree is spilled and the row waits."""
        while self.held > self.limit:
            self._spill()
        if key[:1] in self.spilled:
            pickle.dump((key, row, True), self.spilled[key[:1]])
            return None
        node, at, size = self.root, 0, len(key)
        while at < size:
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += size - at + 200
                node, at = kid, size
            elif key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
            else:
                shared = self._shared(kid.label, key, at)
                fork = node.kids[key[at]] = Node(kid.label[:shared])
                kid.label = kid.label[shared:]
                fork.kids[kid.label[0]] = kid
                self.held += 200
                node, at = fork, at + shared
        if node.owner is None or preference(row) < preference(node.owner):
            node.owner = row
        return node.owner

    @staticmethod
    def _shared(label: bytes, key: bytes, at: int) -> int:
        low, high = 0, min(len(label), len(key) - at)
        while low < high:  # by halves, so that each step compares whole slices
            middle = (low + high + 1) // 2
            if key.startswith(label[:middle], at):
                low = middle
            else:
                high = middle - 1
        return low

    def _spill(self) -> None:
        """Moves the largest subtree below the root to a scratch file; later rows of it follow."""
        sizes = {first: sum(len(n.label) + 200 for n, _ in self._nodes(kid, b"")) for first, kid in self.root.kids.items()}
        first = max(sizes, key=sizes.get)
        file = tempfile.TemporaryFile()  # noqa: SIM115  it has no name, so it goes with the task whatever happens
        for node, key in self._nodes(self.root.kids.pop(first), b""):
            if node.owner is not None:
                pickle.dump((key, node.owner, False), file)
        self.spilled[bytes([first])] = file
        self.held -= sizes[first]

    @staticmethod
    def _nodes(top: Node, before: bytes):
        todo = [(top, before)]
        while todo:
            node, key = todo.pop()
            key += node.label
            yield node, key
            todo.extend((kid, key) for kid in node.kids.values())

    def waiting(self):
        """(row, owner) of the rows that wait in spilled subtrees, one subtree at a time; ends the trie."""
        files, self.spilled, self.root, self.held = self.spilled, {}, Node(b""), 0
        for file in files.values():
            file.seek(0)
            deeper = PatriciaTrie(self.limit)
            while True:
                try:
                    key, row, waits = pickle.load(file)
                except EOFError:
                    break
                owner = deeper.place(key[1:], row)
                if waits and owner is not None:
                    yield row, owner
            file.close()
            yield from deeper.waiting()


def _numbered(docs: DataFrame) -> DataFrame:
    """Row numbers and what rows are dealt by; all in the JVM. The row itself stays as ``row``."""
    text, doc_id = (F.col(f"row.{field_of(docs, n)}") for n in ("text", "doc_id"))
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")
    return carried(docs).withColumns(
        {
            "doc_id": doc_id.cast("long"), "__rid": F.monotonically_increasing_id(), "__points": F.coalesce(F.length(text.cast("string")), F.lit(0)),
            "__plain": plain.cast("binary"),
        }
    ).withColumns({"__len": F.octet_length("__plain"), "__hash": F.xxhash64("__plain")})


def _dealt(rows: DataFrame) -> DataFrame:
    order = ["__len", "__hash", F.col("__points").desc(), F.col("doc_id").asc_nulls_last(), "__rid"]
    return rows.repartition("__len", "__hash").sortWithinPartitions(*order)


def _columns(batch, *names):
    at = {n: i for i, n in enumerate(batch.schema.names)}
    return [batch.column(at[n]) for n in names]


def _owners_in(batch, plain) -> list[int]:
    """For each row of a batch the index of the row that owns its text, by a trie of the batch."""
    keys = list(zip(*(c.to_pylist() for c in _columns(batch, "__points", "doc_id", "__rid")), range(batch.num_rows), strict=True))
    trie, owner = PatriciaTrie(1 << 62), [0] * len(keys)
    for row in sorted(keys, key=preference):
        owner[row[3]] = trie.place(plain(row[3]), row)[3]
    return owner


def _placed(batches, plain_of, row_of):
    """(batch, index, row, owner) of every row of a sorted part; one trie for each length and hash.

    Rows of a spilled subtree come with the last row of their length and hash, as (None, None, row, owner).
    """
    trie, now = PatriciaTrie(), None
    for batch in batches:
        plain, keys = plain_of(batch), zip(*(c.to_pylist() for c in _columns(batch, "__len", "__hash")), strict=True)
        rows = list(zip(*(c.to_pylist() for c in _columns(batch, "__points", "doc_id", "__rid")), strict=True))
        for i, key in enumerate(keys):
            if key != now:
                for row, owner in trie.waiting():
                    yield None, None, row, owner
                trie, now = PatriciaTrie(), key
            row = (*rows[i], row_of(batch, i))
            owner = trie.place(plain(i), row)
            if owner is not None:
                yield batch, i, row, owner
    for row, owner in trie.waiting():
        yield None, None, row, owner


OWNED = pa.schema([("__rep", pa.int64()), ("keep_id", pa.int64()), ("__owner", pa.int64()), ("__rows", pa.int64()), ("text_sha256", pa.string())])
OWNED_DDL = "__rep long, keep_id long, __owner long, __rows long, text_sha256 string"
MEMBERS_DDL = "doc_id long, __rid long, __rep long, __points int, __len int, __hash long, __plain binary, __rows long"


def _members(batches):
    """Each row with the one that stands for its text in its batch; only that one keeps the bytes."""
    for batch in batches:
        plain, rids = _columns(batch, "__plain", "__rid")
        owner = _owners_in(batch, lambda i, plain=plain: plain[i].as_py())
        count = [0] * len(owner)
        for o in owner:
            count[o] += 1
        mine = pa.array([o == i for i, o in enumerate(owner)], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [
                *_columns(batch, "doc_id", "__rid"),
                rids.take(pa.array(owner, pa.int64())),
                *_columns(batch, "__points", "__len", "__hash"),
                pc.if_else(mine, plain, pa.scalar(None, plain.type)),
                pa.array(count, pa.int64()),
            ],
            names=["doc_id", "__rid", "__rep", "__points", "__len", "__hash", "__plain", "__rows"],
        )


def _owned(batches):
    """Each representative with its owner; the owner's row also bears the digest."""
    out: list = []

    def plain_of(batch):
        column = _columns(batch, "__plain")[0]
        return lambda i: column[i].as_py()

    def row_of(batch, i):
        return _columns(batch, "__rows")[0][i].as_py(), hashlib.sha256(_columns(batch, "__plain")[0][i].as_py()).hexdigest()

    def taken():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), OWNED, strict=True)], schema=OWNED)

    for _, _, row, owner in _placed(batches, plain_of, row_of):
        out.append((row[2], owner[1], owner[2], row[3][0], row[3][1] if row[2] == owner[2] else None))
        if len(out) >= 4000:
            yield taken()
            out.clear()
    if out:
        yield taken()


def membership(docs: DataFrame) -> DataFrame:
    """One row a document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are shuffled once, one a batch; members find their owner by the row that stands for them in their batch, so
    the join that carries every document has no key with more rows than a batch.
    """
    rows = _numbered(docs).drop("row")
    first = stored(arrow_pass(rows, _members, MEMBERS_DDL), "dedup-members")
    owned = stored(arrow_pass(_dealt(first.where(F.col("__plain").isNotNull())), _owned, OWNED_DDL), "dedup-owners")
    sizes = owned.groupBy("__owner").agg(F.sum("__rows").alias("group_size"), F.max("text_sha256").alias("text_sha256"))
    classes = owned.select("__rep", "keep_id", "__owner").join(sizes, "__owner")
    return (
        first.select("doc_id", "__rid", "__rep")
        .join(classes, "__rep")
        .select("doc_id", "keep_id", "group_size", (F.col("__rid") == F.col("__owner")).alias("kept"), "text_sha256")
    )


def _text_bytes(text: str):
    def of(batch):
        column = _columns(batch, "row")[0].field(text).cast(pa.string())
        return lambda i: (column[i].as_py() or "").encode().translate(None, DELETED)

    return of


def _thinned(text: str):
    """Leaves out rows that an earlier one of the task owns, as far as a trie of ``THIN_BYTES`` knows; a better one still goes on."""

    def run(batches):
        trie = PatriciaTrie(1 << 62)
        for batch in batches:
            plain = _text_bytes(text)(batch)
            if trie.held > THIN_BYTES:
                trie = PatriciaTrie(1 << 62)
            keys = zip(*(c.to_pylist() for c in _columns(batch, "__points", "doc_id", "__rid")), range(batch.num_rows), strict=True)
            stay = [row[3] for row in sorted(keys, key=preference) if trie.place(plain(row[3]), row[:3]) == row[:3]]
            yield batch.take(pa.array(sorted(stay), pa.int64()))

    return run


def _first_rows(text: str):
    """The rows of a sorted part that own their text, in batches as they come."""

    def run(batches):
        now, stay = None, []
        for batch, i, row, owner in _placed(batches, _text_bytes(text), lambda b, i: b.slice(i, 1)):
            if batch is not now:
                if stay:
                    yield now.take(pa.array(stay, pa.int64()))
                now, stay = batch, []
            if row[2] == owner[2]:
                if batch is None:
                    yield row[3]
                else:
                    stay.append(i)
        if stay:
            yield now.take(pa.array(stay, pa.int64()))

    return run


def survivors(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of ``docs``; one shuffle of what each batch leaves, no join."""
    rows, text = _numbered(docs).drop("__plain"), field_of(docs, "text")
    thin = arrow_pass(rows, _thinned(text), rows.schema)
    return handed_on(arrow_pass(_dealt(thin), _first_rows(text), rows.schema), docs)
