from hypothesis import given, settings
from hypothesis import strategies as st

from gradeframe.functions.lcs import lcs_length, lcs_length_dp

tok = st.lists(st.sampled_from(list("abcdef")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(tok, tok)
def test_bit_parallel_equals_dp(a, b):
    assert lcs_length(a, b) == lcs_length_dp(a, b)


def test_long_sequences():
    a = [str(i % 97) for i in range(3000)]
    b = [str(i % 89) for i in range(2500)]
    assert lcs_length(a, b) == lcs_length_dp(a, b)


@settings(max_examples=300, deadline=None)
@given(tok, tok, st.integers(1, 9))
def test_blocks_hand_on_their_carries(a, b, block):
    assert lcs_length(a, b, block) == lcs_length_dp(a, b)
