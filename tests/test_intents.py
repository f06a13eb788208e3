"""Gates, facets, variants and plans of known texts."""

import pytest

from sparkmoment.functions import intents as I

FAMILIES = {"buffalo": ("buffalo", "trâu"), "flood": ("flood", "lũ lụt")}


def test_chains_and_gates():
    assert I.is_action_chain("enters a room, opens a door") and not I.is_action_chain("a dog, a cat")
    assert I.should_expand("con trâu", FAMILIES, always=True) and not I.should_expand("quiet sky", FAMILIES)
    assert I.should_expand("a dog") and not I.should_expand("a dog", always=True)
    assert I.should_expand("one two three four five six seven eight")
    assert I.looks_long("w " * 12) and not I.looks_long("w " * 11)


def test_facets_of_a_description():
    text = "a large blue-toned banner, decorated with images of mountains, clouds, and a road leading to a school"
    assert I.looks_descriptive(text)
    assert I.descriptive_facets(text) == ["a large blue-toned banner", "decorated with images of mountains, clouds", "and a road leading to a school"]
    assert not I.looks_descriptive("a man is here in the room now and then, sits down there, a woman stands up")


def test_variants():
    assert I.family_variants("a flood and a water buffalo", FAMILIES, ["a photo of a {}", "many {}"]) == ["a photo of a buffalo", "many buffalo", "a photo of a flood", "many flood"]
    assert I.label_variants("one boat here", {"boat": ["Boat", "Ship"], "car": ["Car"]}) == ["Boat", "Boat boat", "Ship", "Ship boat"]
    assert "a blue car" in I.colour_prompts("a Red car", "red") and len(I.colour_prompts("a red car", "red")) == 10 and I.colour_prompts("a car", "red") == []
    labels = {"xe máy": ["Motorcycle"], "xe": ["Vehicle"], "chó": ["dog"]}
    assert I.labels_for("xe máy shark", labels) == ["Motorcycle"] and I.labels_for("dog", labels) == ["dog"] and I.labels_for("kite", labels) == ["kite"] and I.labels_for(" ", labels) == [" "]


@pytest.mark.parametrize(("text", "want"), [('a sign with text "EXIT"', True), ("tấm bảng có chữ [Phở]", True), ("a sign with text EXIT", False), ('the "Titanic"', False)])
def test_writing(text, want):
    assert I.asks_for_writing(text) is want


def test_tokens():
    words = ["Hà Nội", "phở", "bánh"]
    assert I.corrected_token("pho", words) == "phở" and I.corrected_token("banhh", words) == "bánh" and I.corrected_token("--", words) is None and I.corrected_token("xyz", words) == "xyz"
    assert I.corrected_tokens(["pho", "PHO", "...", "xyz"], words) == ["phở", "xyz"]


def test_transcript_plan():
    p = I.transcript_plan("the clip starts with a man who speaks, then a red car")
    assert [r for _, r in p.events] == ["start", "middle"] and p.strict and p.weights == {"visual": 1.0, "asr": 1.0, "object": 0.0}
    assert p.queries[0] == p.text and p.clues == ["red"]
    assert I.transcript_plan("").events == [("", "middle")] and I.transcript_plan("").queries == []
    assert I.transcript_plan("mở cửa", "nghe").queries[0] == "nghe"


def test_second_look():
    assert I.needs_second_look(1, 0, False, False, 0.01) and not I.needs_second_look(1, 1, False, False, 0.2) and I.needs_second_look(1, 0, True, False, None)
