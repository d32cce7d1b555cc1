from corpusloom.operators.vocabulary import MergeState


def test_a_popped_pair_stays_out_until_it_is_refreshed():
    state = MergeState({"ab": 3, "cd": 2})
    assert [state.pop(), state.pop(), state.pop()] == [("c", "##d"), ("a", "##b"), None]
    state.refresh([("a", "##b"), ("x", "##y")])
    assert state.pop() == ("a", "##b") and state.best() is None


def test_a_merge_brings_touched_pairs_back():
    state = MergeState({"abc": 2, "ab": 1, "xy": 5})
    assert state.pop() == ("a", "##b") and state.best() == ("##b", "##c")
    assert state.merge(("a", "##b")) == 2
    assert state.best() == ("ab", "##c") and ("##b", "##c") not in state.current
