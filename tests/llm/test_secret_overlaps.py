"""Weak parts that overlap a strong one without being inside it."""

from seqmine.llm.op2_secrets import find


def test_endpoints_with_a_strong_part_in_them():
    secret = "aB3dE5fG7hJ9kL1mN3pQ5rS7"
    assert [k for *_, k in find("https://host/v1?token=abcdefghijkl12")] == ["endpoint", "assign"]
    assert [k for *_, k in find(f"https://host/v1?token=abcdefghijkl12 {secret}")] == ["endpoint", "assign", "secret"]
    assert [k for *_, k in find(f"https://host/0123456789abcdef01/x {secret}")] == ["endpoint", "hex", "secret"]
    assert [k for *_, k in find(f"password={secret} and no more")] == ["assign"]  # the secret is inside
