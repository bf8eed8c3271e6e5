"""Where the files of public tokenizers lie: a folder of them, or the package that brings them."""

from __future__ import annotations

import os

FOLDER = "CORPUS_TOKENIZERS"


def tokenizer_file(name: str) -> str:
    """The path of a vocabulary file, the same on driver and executors.

    The folder in the environment variable ``CORPUS_TOKENIZERS`` counts first.
    """
    if folder := os.environ.get(FOLDER):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
