"""Front-coded sorted runs of suffixes, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

Entry = tuple[bytes, bytes]  # suffix and what goes along with it


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, which agree in the first ``known`` bytes."""
    n = min(len(a), len(b))
    if known >= n:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not x else n - 1 - (x.bit_length() - 1) // 8


def encode_run(entries: list[Entry]) -> bytes:
    """A run in ascending order: each suffix without the prefix it shares with the one before."""
    out, before = bytearray(), b""
    for suffix, load in entries:
        shared = common_prefix(before, suffix)
        for n in (shared, len(suffix) - shared, len(load)):
            out += n.to_bytes(3, "little")
        out += suffix[shared:]
        out += load
        before = suffix
    return bytes(out)


def decode_run(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(length shared with the one before, suffix, load) of each entry."""
    at, before = 0, b""
    while at < len(run):
        shared, rest, load = (int.from_bytes(run[at + k : at + k + 3], "little") for k in (0, 3, 6))
        at += 9
        before = before[:shared] + run[at : at + rest]
        at += rest
        yield shared, before, run[at : at + load]
        at += load


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """All entries in order, each with the length it shares with the one before.

    Every head carries the length of its common prefix with the last entry given out. Of two heads the one with the
    longer prefix is smaller, without a look at the bytes; only for equal lengths the bytes after that prefix are
    compared, and what is found is kept with the loser. The winner's successor brings its length from the front coding.
    """
    sources = [decode_run(r) for r in runs]
    k = 1
    while k < len(sources):
        k *= 2
    heads: list[tuple[bytes, bytes] | None] = [None] * k
    shared = [0] * k  # with the last entry given out

    def advance(i: int) -> None:
        item = next(sources[i], None) if i < len(sources) else None
        if item is None:
            heads[i] = None
        else:
            shared[i], heads[i] = item[0], (item[1], item[2])

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two heads; the loser's prefix becomes that with the winner."""
        a, b = heads[i], heads[j]
        if a is None:
            return j, i
        if b is None:
            return i, j
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        known = shared[i]
        n = common_prefix(a[0], b[0], known)
        if n == len(a[0]) and n == len(b[0]):
            first = i < j
        elif n == len(a[0]) or n == len(b[0]):
            first = n == len(a[0])
        else:
            first = a[0][n] < b[0][n]
        winner, loser = (i, j) if first else (j, i)
        shared[loser] = n
        return winner, loser

    for i in range(k):
        advance(i)
        shared[i] = 0
    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        suffix, load = heads[winner]
        yield shared[winner], suffix, load
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
