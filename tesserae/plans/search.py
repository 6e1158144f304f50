"""Memoised monotone search over an ordered ladder: the first rung that fits, with few measurements."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence


def first_fit(rungs: Sequence[Hashable], fits: Callable[[Hashable], bool], known: dict | None = None) -> tuple[Hashable | None, dict]:
    """(first rung that fits or None, all verdicts). Fitting is monotone: strides double, then halves decide."""
    verdicts = dict(known or {})

    def ask(i: int) -> bool:
        if rungs[i] not in verdicts:
            verdicts[rungs[i]] = fits(rungs[i])
        return verdicts[rungs[i]]

    low, high = 0, len(rungs)
    probe, stride = 0, 1
    while probe < len(rungs):
        if ask(probe):
            high = probe
            break
        low, probe, stride = probe + 1, probe + stride, stride * 2
    while low < high:
        middle = (low + high) // 2
        if ask(middle):
            high = middle
        else:
            low = middle + 1
    return (rungs[low] if low < len(rungs) else None), verdicts
