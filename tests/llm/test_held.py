"""A worker keeps one thing at a time."""

import gc
import weakref

from opsloom.llm.held import drop, held


class Thing:
    pass


def test_the_last_thing_goes_before_the_next_is_built():
    drop()
    key = {}
    one = held(key, Thing)
    assert held(key, Thing) is one
    gone = weakref.ref(one)
    del one

    def build():
        gc.collect()
        assert gone() is None
        return Thing()

    two = held("name", build)
    assert held("na" + "me", Thing) is two and held({}, Thing) is not two
    last = weakref.ref(held("x", Thing))
    drop()
    gc.collect()
    assert last() is None
