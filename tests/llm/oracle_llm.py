"""Plain versions of decisions, on collected rows."""

import re

from test_near_copies import plain_components

DATA = "/root/testdata/sf0.001"


def same_texts(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    return set(first.values())


def near_components(rows):
    return set(plain_components([(r.doc_id, r.text) for r in rows]))
