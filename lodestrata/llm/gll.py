"""Generalised LL parsing with a graph-structured stack.

Any context-free grammar, ambiguous or left-recursive, over strings of one-character token classes. The stack is a graph
whose nodes are (nonterminal, start); a node's results are the positions at which the nonterminal can end.
"""

from __future__ import annotations

from collections import defaultdict

Grammar = dict[str, tuple[tuple[str, ...], ...]]


class Parse:
    """All ends of every nonterminal at the positions that the parse has visited."""

    def __init__(self, grammar: Grammar, tokens: str, start: str, at: int = 0):
        self.ends: dict[tuple[str, int], set[int]] = defaultdict(set)
        # Edges of the graph-structured stack: who waits for a node, and in which slot it goes on.
        waiting: dict[tuple[str, int], set[tuple[str, int, int, int]]] = defaultdict(set)
        started: set[tuple[str, int]] = set()
        seen: set[tuple[str, int, int, int, int]] = set()
        todo: list[tuple[str, int, int, int, int]] = []  # (nonterminal, its start, alternative, slot, position)

        def push(item: tuple[str, int, int, int, int]) -> None:
            if item not in seen:
                seen.add(item)
                todo.append(item)

        def begin(symbol: str, position: int) -> None:
            if (symbol, position) not in started:
                started.add((symbol, position))
                for k in range(len(grammar[symbol])):
                    push((symbol, position, k, 0, position))

        begin(start, at)
        while todo:
            symbol, origin, k, slot, position = todo.pop()
            rule = grammar[symbol][k]
            if slot == len(rule):
                node = (symbol, origin)
                if position not in self.ends[node]:
                    self.ends[node].add(position)
                    for s, o, a, n in waiting[node]:
                        push((s, o, a, n, position))
                continue
            wanted = rule[slot]
            if wanted in grammar:
                node = (wanted, position)
                waiting[node].add((symbol, origin, k, slot + 1))
                begin(wanted, position)
                for end in tuple(self.ends[node]):
                    push((symbol, origin, k, slot + 1, end))
            elif position < len(tokens) and (wanted == tokens[position] or wanted == "*"):
                push((symbol, origin, k, slot + 1, position + 1))

    def spans(self, symbol: str) -> list[tuple[int, int]]:
        return sorted((start, end) for (s, start), ends in self.ends.items() if s == symbol for end in ends)
