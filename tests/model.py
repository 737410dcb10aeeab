"""A sequential model of the rules, to test the set-oriented plans against."""

import regex

SPACE = regex.compile(r"\p{White_Space}+")


def clean(t):
    return SPACE.sub(" ", t or "").strip(" ")


def nodes(rows, store):
    """rows: (batch, pos, kind, granularity, level, text); store: {norm: batch}. Reasons by (batch, pos)."""
    known, out = {}, {}
    last, seen = None, set()
    for b, p, kind, gran, level, text in sorted(rows, key=lambda r: r[:2]):
        if b != last:
            last, seen = b, set()
        t = clean(text)
        norm = t.lower()
        if gran != "Sentence":
            r = "granularity must be sentence"
        elif not 0 <= level <= 3:
            r = "level must be between 0 and 3"
        elif not t:
            r = "node text is empty after trimming"
        elif sum(c in ".!?" for c in t) != 1 or t[-1] not in ".!?":
            r = "node text must be a single sentence"
        elif kind == "LearningOutcome" and not norm.startswith(("i can ", "students can ")):
            r = "learning outcomes must start with 'I can' or 'Students can'"
        elif norm in seen:
            r = "duplicate node within batch"
        else:
            seen.add(norm)
            if norm in known or store.get(norm, b) < b:
                r = "duplicate node already present"
            else:
                known[norm] = b
                r = None
        out[b, p] = r
    return out


def edges(rows, node, stored):
    """rows: (batch, pos, relation, from, to, rationale); node: {id: (kind, level)}; stored: {(from, to, relation)}."""
    there, out = set(stored), {}
    last, seen = None, set()

    def leads(a, b):
        stack, met = [a], {a}
        while stack:
            x = stack.pop()
            if x == b:
                return True
            for f, t, r in there:
                if f == x and r == "PrerequisiteFor" and t not in met:
                    met.add(t)
                    stack.append(t)
        return False

    for b, p, rel, f, t, why in sorted(rows, key=lambda r: r[:2]):
        if b != last:
            last, seen = b, set()
        key, pre = (f, t, rel), rel == "PrerequisiteFor"
        if key in seen:
            r = "duplicate edge within batch"
        else:
            seen.add(key)
            if f not in node:
                r = f"unknown from_id {f}"
            elif t not in node:
                r = f"unknown to_id {t}"
            elif f == t:
                r = "self-loops are not allowed"
            elif key in there:
                r = "edge already exists"
            elif pre and leads(t, f):
                r = "edge would introduce a prerequisite cycle"
            elif pre and node[f][0] != "Concept":
                r = "prerequisite edges must originate from a concept"
            elif pre and node[f][1] > node[t][1]:
                r = "prerequisite edges must not decrease level"
            elif not clean(why):
                r = "edge rationale missing"
            else:
                there.add(key)
                r = None
        out[b, p] = r
    return out
