"""What is done with a query text once it is read: gates, facets, families of variants, transcript plans.

Everything is read off the cues of ``querytext``. Vocabularies larger than a handful of words (families
of animals and disasters, detector labels of other languages) are arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from difflib import get_close_matches

from . import querytext as Q

# Words that results depend on.
LONG, EXPANDED = 12, 8  # words from which a query is long, and from which it is always expanded
FACET_STARTS = ("the", "a", "an", "and", "with", "of", "decorated", "featuring", "showing", "displaying", "wearing", "picture", "pictures")
SUBJECT_STARTS = ("he", "she", "they", "we", "i", "it", "the person", "the man", "the woman", "the boy", "the girl", "a person", "a man", "a woman", "a boy", "a girl")
WRITTEN_MARKERS = ("có chữ", "dòng chữ", "viết", "text")
PROMPT_COLOURS = ("red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white", "gray")


def steps(text: str) -> int:
    """Steps of an action chain: commas before an action part them."""
    return 1 + sum(chain for *_, chain in Q._cuts(Q.Reading(text)))


def is_action_chain(text: str) -> bool:
    return steps(text) >= 2


def looks_long(text: str) -> bool:
    return len(text.split()) >= LONG


def _clauses(text: str) -> list[str]:
    r = Q.Reading(text)
    commas = [i for i, w in enumerate(r.words) if w.low == ","]
    return [r.spelt(a + 1, b) for a, b in zip([-1, *commas], [*commas, len(r.words)], strict=True) if a + 1 < b]


def _begins(clause: str, starts: Iterable[str]) -> bool:
    words = clause.lower().split()
    return any(words[: len(s.split())] == s.split() for s in starts)


def looks_descriptive(text: str) -> bool:
    """A long text with commas that lists facets of one scene: no step of an action chain in it begins with a subject."""
    told = is_action_chain(text) and any(_begins(c, SUBJECT_STARTS) for c in _clauses(text)[1:])
    return looks_long(text) and "," in text and not told


def descriptive_facets(text: str) -> list[str]:
    """The text cut at commas before a facet; facets of one word are left out."""
    out: list[str] = []
    for c in _clauses(text):
        if out and not _begins(c, FACET_STARTS):
            out[-1] += f", {c}"
        else:
            out.append(c)
    return [f for f in (" ".join(x.split()).strip(" ,;|/-") for x in out) if len(f.split()) >= 2]


def named(text: str, families: Mapping[str, Sequence[str]]) -> list[str]:
    """Members of a family (an animal, a disaster) that the text names as whole words."""
    return Q.concepts(text, families) if families else []


def family_variants(text: str, families: Mapping[str, Sequence[str]], phrasings: Sequence[str]) -> list[str]:
    """Every named member in every phrasing, as "a photo of a {}"."""
    return [p.format(m) for m in named(text, families) if m != "animal" for p in phrasings]


def label_variants(text: str, labels: Mapping[str, Sequence[str]]) -> list[str]:
    """For every keyword of the text its detector labels, and each with the keyword beside it."""
    keys = Q._concept_cues(tuple((k, (k,)) for k in labels)).scan(Q.words_of(text))
    found = dict.fromkeys(c.value for c in keys)
    return list(dict.fromkeys(v for k in found for label in labels[k] for v in (label, f"{label} {k}")))


def should_expand(text: str, families: Mapping[str, Sequence[str]] | None = None, always: bool = False) -> bool:
    """Whether variants help: an action chain or a member of a family; unless asked for ``always`` only, also eight words or any concept."""
    if is_action_chain(text) or (families and any(m != "animal" for m in named(text, families))):
        return True
    return not always and (len(text.split()) >= EXPANDED or bool(Q.concepts(text)))


def colour_prompts(text: str, colour: str) -> list[str]:
    """The text with its colour changed to each other one; none without the colour."""
    r = Q.Reading(text)
    at = [w for w in r.words if w.low == colour.lower()]
    if not at:
        return []

    def changed(other: str) -> str:
        out, last = "", 0
        for w in at:
            out, last = out + r.text[last : w.start] + other, w.end
        return out + r.text[last:]

    return [changed(c) for c in sorted(PROMPT_COLOURS) if c != colour.lower()]


def labels_for(entity: str, labels: Mapping[str, Sequence[str]]) -> list[str]:
    """Detector labels of an entity: its own entry, itself where it is a label, the longest entry that begins it or that it begins, else itself."""
    key = entity.strip().lower()
    if not key:
        return [entity]
    if key in labels:
        return list(labels[key])
    if any(key in v for v in labels.values()):
        return [key]
    near = max((k for k in labels if key.startswith(k) or k.startswith(key)), key=len, default=None)
    return list(labels[near]) if near else [entity]


def asks_for_writing(text: str) -> bool:
    """Whether a quoted or bracketed stretch stands beside a word for writing."""
    rest = Q.fold(Q._KEPT.sub(" ", text))
    return bool(Q._KEPT.search(text)) and any(Q.fold(m) in rest for m in WRITTEN_MARKERS)


def needs_second_look(events: int, attributes: int, counted: bool, placed: bool, margin: float | None) -> bool:
    """Whether a costly ranker is asked: counts, places, two attributes or events, or a lead of less than .05."""
    return counted or placed or attributes >= 2 or events >= 2 or (margin is not None and margin < 0.05)


def corrected_token(token: str, vocabulary: Iterable[str], noise: Callable[[str], bool] | None = None, likeness: float = 0.8) -> str | None:
    """The token as the vocabulary spells it (accents and letter case aside, else the nearest word alike enough), itself
    where nothing is near; None for noise: by default what has no letter or digit."""
    t = token.strip()
    if not t or (noise(t) if noise else not any(c.isalnum() for c in t)):
        return None
    by_form = {Q.fold(v): v for v in vocabulary}
    form = Q.fold(t)
    if form in by_form:
        return by_form[form]
    near = get_close_matches(form, by_form, 1, likeness)
    return by_form[near[0]] if near else t


def corrected_tokens(tokens: Iterable[str], vocabulary: Iterable[str]) -> list[str]:
    """Corrected tokens without noise, each once, in order."""
    known = list(vocabulary)
    return list(dict.fromkeys(c for t in tokens if (c := corrected_token(t, known)) is not None))


@dataclass
class TranscriptPlan:
    """What a transcript search is to look for."""

    text: str
    language: str
    events: list[tuple[str, str]]
    key_words: list[list[str]]
    queries: list[str]
    clues: list[str]
    constraints: list[tuple[str, str, str, int]]
    weights: dict[str, float] = field(default_factory=dict)
    strict: bool = False


def transcript_plan(text: str, speech: str | None = None) -> TranscriptPlan:
    """A plan without a model: queries are the text (or what is to be heard), its events and its actions.

    Colours and places are visual clues. Speech weighs 1 where the text speaks of it, else .7; labels .5
    where there are actions. Several events or an order among them make it strict. An empty text has one empty event.
    """
    said = speech or text
    found = Q.events(text) or [(text, "middle")]
    acts = Q.actions(text)
    r = Q.Reading(text)
    clues = Q.colours(text) + Q.spatial(text)
    queries = list(dict.fromkeys(q for q in (said, *(e.strip() for e, _ in found), *(a for a in acts if len(a) >= 2)) if q))
    ordered = len(found) > 1 or any(role in ("first", "last") for _, role in found)
    weights = {"visual": 1.0 if clues or acts else 0.8, "asr": 1.0 if r.has("speech sign") else 0.7, "object": 0.5 if acts else 0.0}
    return TranscriptPlan(text, Q.language(text), found, [Q.actions(e) for e, _ in found], queries, clues, Q.constraints(text), weights, ordered)
