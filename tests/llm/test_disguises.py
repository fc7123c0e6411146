"""Plain disguises of personal data, and text that only looks like one."""

import pytest

from lotscope.llm import pii


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("mail jo (at) example dot com today", "email", "jo (at) example dot com"),
        ("mail jo.smith@example dot com today", "email", "jo.smith@example dot com"),
        ("ask jo dot smith at example dot com.", "email", "jo dot smith at example dot com"),
        ("mail jo[@]example[.]com today", "email", "jo[@]example[.]com"),
        ("mail jo at example (dot) co dot uk today", "email", "jo at example (dot) co dot uk"),
        ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 5 192 dot 168 dot 0 dot 1 5 up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 192[.]168[.]1[.]7 is up", "ip", "192[.]168[.]1[.]7"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("host one nine two (dot) 168 (dot) one (dot) one up", "ip", "one nine two (dot) 168 (dot) one (dot) one"),
        ("host one nine two.one 68.zero.one up", "ip", "one nine two.one 68.zero.one"),
        ("call +1 four one five 555 0 one two three now", "phone", "+1 four one five 555 0 one two three"),
        ("call +49 one seven two 555 one two three four now", "phone", "+49 one seven two 555 one two three four"),
        ("in 2019, plus 49 one seven two 555 1234 now", "phone", "plus 49 one seven two 555 1234"),
        ("card 4111 one one one one 1111 1111 ok", "card", "4111 one one one one 1111 1111"),
        ("of 100, four" + " one" * 15 + ", 2019", "card", "four" + " one" * 15),
    ],
)
def test_plain_disguises_are_found_at_their_source(text, kind, shown):
    base, every = pii.spans(text)
    assert base == [] and [(text[s:e], k) for s, e, k in every] == [(shown, kind)]


@pytest.mark.parametrize(
    "text",
    [
        "visit us at example.com", "jo@example.com dot the i", "a (.) b [@] c", "version 1 dot 2 dot 3", "300 dot 1 dot 1 dot 1",
        "one of 25 and two of 1000 people", "four one five 555 0 one two three", "192.168.0.1 one two",
    ],
)
def test_what_is_no_disguise_adds_nothing(text):
    base, every = pii.spans(text)
    assert base == every


def test_runs_of_words_and_dots_take_linear_time():
    for piece in ("one ", "1 dot ", "a dot ", "one dot ", "one 1 ", "12 one, ", "a@b dot ", "[.]", "one.", "1[.]", "plus one "):
        pii.spans(piece * 40_000)
