"""Which parts of a growing index to merge: policies from sizes to groups."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Mapping

Policy = Callable[[Mapping[int, int]], list[list[int]]]


def log_size(factor: int = 10, floor: int = 2 << 20) -> Policy:
    """Merge ``factor`` parts of one level; a level holds sizes within that factor, all below ``floor`` are one."""

    def choose(sizes: Mapping[int, int]) -> list[list[int]]:
        levels: dict[int, list[int]] = defaultdict(list)
        for part in sorted(sizes):
            levels[math.floor(math.log(max(sizes[part], floor), factor) + 1e-9)].append(part)
        return [own[i : i + factor] for _, own in sorted(levels.items()) for i in range(0, len(own) - factor + 1, factor)]

    return choose


def tiered(per_tier: int = 10, at_once: int = 10, largest: int = 5 << 30) -> Policy:
    """Merge the smallest parts while there are more than tiers of ``per_tier`` parts allow; none grows beyond ``largest``."""

    def choose(sizes: Mapping[int, int]) -> list[list[int]]:
        parts = sorted((p for p in sizes if sizes[p] * 2 <= largest), key=lambda p: (sizes[p], p))
        if not parts:
            return []
        allowed, size, left = 0, max(sizes[parts[0]], 1), sum(sizes[p] for p in parts)
        while left > 0:
            allowed += min(per_tier, math.ceil(left / size))
            left -= per_tier * size
            size *= at_once
        out = []
        while len(parts) > allowed and len(parts) > 1:
            group, total = [], 0
            for p in parts[:at_once]:
                if group and total + sizes[p] > largest:
                    break
                group.append(p)
                total += sizes[p]
            if len(group) < 2:
                break
            out.append(group)
            parts = parts[len(group) :]
            allowed -= 1  # what is merged stays as one part
        return out

    return choose


def everything(sizes: Mapping[int, int]) -> list[list[int]]:
    """One part of all."""
    return [sorted(sizes)] if len(sizes) > 1 else []
