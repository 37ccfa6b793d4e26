"""Merging of sorted runs of strings by a tree of losers that knows common prefixes.

Each string comes with the length of the prefix it shares with the one before it in its run. A node keeps the loser of its
last match and how many bytes that string shares with the winner, so two strings are compared from the shorter of
those lengths on, and not at all if the lengths differ: the one that shares more with the last string put out is less.
"""

from __future__ import annotations


def merge(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """runs: strings of `width` bytes, ascending, and what each shares with the one before. The run of each string in merged order, and what it shares with the one before; equal strings in the order of runs."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [s for s, _ in runs] + [[]] * (k - len(runs))
    shared = [c for _, c in runs] + [[]] * (k - len(runs))
    at = [0] * k
    head = [s[0] if s else b"" for s in strings]  # of an ended run: empty, and -1 bytes shared, so that it loses
    node, node_shares = [0] * k, [0] * k

    def play(x: int, x_shares: int, y: int, y_shares: int):
        """The winner and what it shares with the string before; the loser and what it shares with the winner."""
        if x_shares != y_shares:
            return (x, x_shares, y, y_shares) if x_shares > y_shares else (y, y_shares, x, x_shares)
        if x_shares < 0:
            return x, -1, y, -1
        a, b = head[x][x_shares:], head[y][x_shares:]
        if a == b:
            return (x, x_shares, y, width) if x < y else (y, y_shares, x, width)
        common = width - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8
        return (x, x_shares, y, common) if a < b else (y, y_shares, x, common)

    def first(i: int):
        if i >= k:
            return i - k, 0 if strings[i - k] else -1
        (x, xs), (y, ys) = first(2 * i), first(2 * i + 1)
        w, ws, node[i], node_shares[i] = play(x, xs, y, ys)
        return w, ws

    winner, shares = first(1)
    out, out_shares = [], []
    while shares >= 0:
        out.append(winner)
        out_shares.append(shares)
        n = at[winner] = at[winner] + 1
        if n < len(strings[winner]):
            head[winner], shares = strings[winner][n], shared[winner][n]
        else:
            shares = -1
        i = (winner + k) // 2
        while i:
            other = node_shares[i]
            if other > shares:
                winner, node[i], shares, node_shares[i] = node[i], winner, other, shares
            elif other == shares and other >= 0:
                winner, shares, node[i], node_shares[i] = play(winner, shares, node[i], other)
            i //= 2
    return out, out_shares
