"""Keys proposed by a language model: asked for once a table, checked against the data, cut to what identifies, asked again once.

Nothing that a provider answers is used unless its columns exist and its key is strong on the data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame

from cotejo.functions.text import KEY_FORMS
from cotejo.operators.configure import Provider, file_profile, json_in
from cotejo.operators.keys import LEAST_STRENGTH, key_strength, visible


@dataclass(frozen=True)
class ProposedKey:
    """keys: the columns of each table, in the order of the tables, which pair up; strength: the least over the tables."""

    keys: tuple[tuple[str, ...], ...]
    form: str
    strength: float


@dataclass(frozen=True)
class Proposal:
    found: ProposedKey | None
    invented: int
    rounds: int
    notes: tuple[str, ...] = ()


def _prompt(tables: list[DataFrame], names: list[str], samples: int, complaint: str) -> str:
    shown = [f"{n}: " + "; ".join(f"{c}: {', '.join(file_profile(df, c, samples, samples))}" if samples else c for c in visible(df)) for n, df in zip(names, tables)]
    asked = f'Which columns identify the same records? Answer with one JSON object: {{"keys": [columns of each table], "form": one of {list(KEY_FORMS)}}}.'
    return "\n".join(["Tables:", *shown, asked, *([f"The last answer was wrong: {complaint}"] if complaint else [])])


def _read(answer: str, tables: list[DataFrame]) -> tuple[list[list[str]], str, int, str]:
    """(existing columns by table, form, columns that do not exist, what is wrong)."""
    try:
        given = json.loads(json_in(answer))
    except ValueError as e:
        return [], "exact", 0, str(e)
    lists = [[str(c) for c in (own if isinstance(own, list) else [own])] for own in given.get("keys") or []]
    form = given.get("form") if given.get("form") in KEY_FORMS else "exact"
    if len(lists) != len(tables):
        return [], form, 0, f"{len(lists)} keys for {len(tables)} tables"
    unknown = [c for own, df in zip(lists, tables) for c in own if c not in df.columns]
    if unknown:
        return lists, form, len(unknown), f"no column {', '.join(unknown)}"
    if len({len(own) for own in lists}) != 1 or not lists[0]:
        return lists, form, 0, "the keys need equally many columns"
    return lists, form, 0, ""


def _strength(tables: list[DataFrame], keys: list[list[str]], form: str) -> float:
    return min(key_strength(tables[0], keys[0], df, own, form) for df, own in zip(tables[1:], keys[1:]))


def smallest_key(tables: list[DataFrame], keys: list[list[str]], form: str, least: float = LEAST_STRENGTH) -> ProposedKey | None:
    """The fewest of the paired columns, in any form, that still make a key of strength `least`; of equally few the strongest."""
    width = len(keys[0])
    for size in range(1, width + 1):
        tried = []
        for places in combinations(range(width), size):
            part = [[own[i] for i in places] for own in keys]
            for f in dict.fromkeys([form, *KEY_FORMS]):
                tried.append(ProposedKey(tuple(map(tuple, part)), f, _strength(tables, part, f)))
        best = max(tried, key=lambda k: k.strength)
        if best.strength >= least:
            return best
    return None


def propose_keys(provider: Provider, tables: list[DataFrame], names: list[str] | None = None, samples: int = 5, rounds: int = 2) -> Proposal:
    """A checked key of all tables, the first being the anchor. samples: values shown per column, 0 for names only."""
    names = names or [f"table{i + 1}" for i in range(len(tables))]
    invented, complaint, notes = 0, "", []
    for turn in range(1, rounds + 1):
        keys, form, unknown, complaint = _read(provider.complete(_prompt(tables, names, samples, complaint)), tables)
        invented += unknown
        if not complaint:
            found = smallest_key(tables, keys, form)
            if found:
                return Proposal(found, invented, turn, tuple(notes))
            complaint = f"{' + '.join(keys[-1])} does not identify the same records"
        notes.append(complaint)
    return Proposal(None, invented, rounds, tuple(notes))


def propose_pair_key(provider: Provider, a: DataFrame, b: DataFrame, samples: int = 5) -> Proposal:
    """The same for two tables."""
    return propose_keys(provider, [a, b], ["A", "B"], samples)
