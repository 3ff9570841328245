from __future__ import annotations

import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def ranks() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="session")
def description() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="session")
def odd_texts() -> list[str | None]:
    """Nulls, empty and very long texts, repeats, white space of all kinds, other scripts, special strings."""
    return [
        None, "", " ", "\n\n \t", "a", "Hello, world! It's 12:30.", "Hello, world! It's 12:30.", "x" * 30_000, "ab " * 20_000, " " * 5_000 + "end", "日本語のテキスト " * 50, "naïve café Straße",
        "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "\x1c\x85  tail", "🙂🙂🙂 mixed ١٢٣ text", "tab\tand\r\nlines\x0b\x0c", "'s 't 're 've 'm 'll 'd don't", "aaaaaaaaaaaaaaaaaaaaaaaaa",
    ]
