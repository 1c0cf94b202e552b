import random

from barloom.llm import bpe
from public_tokenizers import PATTERN, path


def test_whole_pieces_have_the_tokens_of_their_prefixes():
    """One loop makes what the array that takes edits makes, also where the remembered pairs are forgotten on the way."""
    v, draw = bpe.Vocabulary(path("byte_bpe_50k.tiktoken"), PATTERN), random.Random(5)
    for n in [*range(1, 40), 300, 3000] * 4:
        raw = bytes(draw.choices([*b"aabeiht .\n", *"éß中".encode(), *range(256)], k=n))
        if n % 7 == 0:
            v._tested = bpe.CACHED_PAIRS
        assert v._tokens(raw) == bpe.Prefixes(v, raw).tokens()
    assert v.decode(v.encode("ab ퟿ 中\n\n x" * 50)) == ("ab ퟿ 中\n\n x" * 50).encode()
