"""Random strings of one kind of characters."""

from lectern.llm import secret_scan
from lectern.llm.queries import vocabulary


def test_random_runs_of_any_letters():
    count = secret_scan.token_counter(vocabulary("byte_bpe_50k.tiktoken"))
    for run in ("K7Q9ZX2LMP4VT8RB1WN6", "JBSWY3DPEHPK3PX7", "qXvKzRtYpLmWnBcDfGhJ"):
        assert secret_scan.random_spans(f"a {run} b", count, 2.2) == [(2, 3, 2 + len(run))]
    for run in ("internationalization", "2024-01-01_2024-12-31", "----------------------"):
        assert not secret_scan.random_spans(f"a {run} b", count, 2.2)
