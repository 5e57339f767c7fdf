import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import words  # noqa: E402


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, very long, equal and odd texts."""
    long = " ".join(words(1, 30_000))
    return [None, "", " ", "\n\n", "a", "a b c", "...", "Ünïcödé \U0001F916 日本語", "same text of five words", "same text of five words",
            long, long, "ha " * 5000, "x" * 20_000, "\x00\t\x1c", "▁mark ▁▁ marks <s> </s> <unk> <0x41>"]
