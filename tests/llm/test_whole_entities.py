"""Entities are found from end to end."""

from __future__ import annotations

import pytest

from lumenkg.llm import pii


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mr John F. Kennedy left.", {"John F.": "m", "Kennedy": "family"}),
        ("Mr. J. R. R. Tolkien wrote.", {"J. R. R. Tolkien": "family"}),
        ("Mr J.R.R. Tolkien wrote.", {"J.R.R. Tolkien": "family"}),
        ("Mr John F Kennedy left.", {"John F": "m", "Kennedy": "family"}),
        ("Mrs Anne-Marie Smith's house", {"Anne-Marie": "f", "Smith": "family"}),
        ("Mr Sean Patrick Michael O'Neil. I saw", {"Sean": "m", "Patrick": "m", "Michael": "m", "O'Neil": "family"}),
        ("Herr Dr. Ludwig van Beethoven und Frau Schmidt", {"Ludwig": "m", "Beethoven": "family", "Schmidt": "family"}),
        ("Mr Smith I think", {"Smith": "family"}),
        ("Mr Smith. Then Mr smith", {"Smith": "family"}),
        ("Mr John F. Kennedy. So John F. Kennedy went", {"John F.": "m", "Kennedy": "family"}),
    ],
)
def test_names(text, want):
    found = pii.entities(text)
    assert {text[a:b]: k.rsplit(":", 1)[1] for a, b, k, _ in found} == want
    new = pii.replaced(text, found, b"key", {}, {})
    assert not any(name in new for name in want)
    assert [e[2] for e in pii.entities(new)] == [e[2] for e in found] and "F." not in new


@pytest.mark.parametrize("secret", ["a1" * 400, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P", "abcd1234+/abcd=="])
def test_secrets(secret):
    text = f'token = "{secret}". Then'
    assert [text[a:b] for a, b, _, _ in pii.entities(text)] == [secret]
    text = f"token: {secret}. Then"
    assert [text[a:b] for a, b, _, _ in pii.entities(text)] == [secret]


@pytest.mark.parametrize("address", ["2001:db8::1", "::1", "fe80::a1b:2c3d", "2001:db8:0:0:0:0:0:1", "::ffff:192.0.2.7", "2001:db8::"])
def test_addresses(address):
    for end in (".", " it") if address.endswith(":") else (".", ": it", " it"):
        text = f"from {address}{end}"
        found = pii.entities(text)
        assert [text[a:b] for a, b, _, _ in found] == [address]
        assert [e[2] for e in pii.entities(pii.replaced(text, found, b"key", {}, {}))] == ["ip6"]
    assert pii.entities("2001:db8::1 2001:0DB8:0::1")[0][3] == pii.entities("2001:db8::1 2001:0DB8:0::1")[1][3]
    assert not pii.entities("at 12:30:45, std::vector<int> 1::2::3, 1:2 and :: too")
