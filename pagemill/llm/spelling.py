"""Complete candidate retrieval: a Levenshtein automaton with recognition confusions, intersected with a vocabulary trie."""

from __future__ import annotations

from collections.abc import Iterable

#: What recognition makes of which letters: seen -> meant. Marks put inside a word are in MARKS.
CONFUSIONS = {
    "0": ("o",), "1": ("l", "i"), "|": ("l", "i"), "!": ("i", "l"), "5": ("s",), "§": ("s",), "$": ("s",), "†": ("t",), "¢": ("c",), "@": ("a",), "6": ("b",), "8": ("b",), "9": ("g",), "3": ("e",), "7": ("t",), "2": ("z",),
    "c": ("e",), "e": ("c",), "rn": ("m",), "m": ("rn", "in", "ni"), "cl": ("d",), "d": ("cl",), "li": ("h",), "h": ("li", "n", "b"), "b": ("h",), "ii": ("u",), "u": ("ii", "n"), "ri": ("n",), "n": ("ri", "h", "u"), "in": ("m",), "ni": ("m",),
    "vv": ("w",), "w": ("vv",), "l": ("i", "t"), "i": ("l", "j"), "t": ("f",), "f": ("t",), "€": ("e",), "£": ("e",), "©": ("c",), "®": ("r",), "¥": ("y",), "µ": ("u",), "q": ("g",), "(": ("c",), "v": ("y",), "y": ("v",),
}
#: Signs that recognition drops into words.
MARKS = frozenset("*^~¬'`´¸·•_=#\"\\<>{}[]:;.,+-\u00ad")
ERRORS = 2
#: The digits that the shapes in a misread number stand for; capitals have other shapes than small letters.
DIGITS = str.maketrans("lLiI|!oOsS§bBgGqQzZaAtT†eE", "11111100555689690224477733", "*^~¬")
#: The letters that the digits and signs in a misread word stand for, where no word of the vocabulary tells.
LETTERS = {seen: meant[0] for seen, meant in CONFUSIONS.items() if not seen.isalpha()}


#: Words up to this length have no piece that two errors must leave whole; they share one key.
SHORT = 5


def word_pieces(word: str) -> set[str]:
    """Keys of a vocabulary word: of its beginning, middle and end, at least one stands whole in every token within two errors.

    An error (a confusion, a mark or an edit) touches two letters of the word at most.  Each of the two cuts may lie at
    two places, of which no error covers both; so with the right cuts two errors lie in two of the three pieces.
    """
    n = len(word)
    if n <= SHORT:
        return {"\x01"}
    a = n // 3
    cuts = (a, a + 1)
    return {f"^{word[:c]}" for c in cuts} | {f"{word[n - c :]}$" for c in cuts} | {f"-{word[c : n - d]}" for c in cuts for d in cuts}


def token_pieces(token: str) -> set[str]:
    """All keys by which a word within two errors of the token may be found.

    An error changes the length by one at most, and the middle is needed only if one error lies before and one behind it.
    """
    m = len(token)
    keys = {"\x01"} if m <= SHORT + ERRORS else set()
    for n in range(max(SHORT + 1, m - ERRORS), m + ERRORS + 1):
        for c in (n // 3, n // 3 + 1):
            keys |= {f"^{token[:c]}", f"{token[max(0, m - c) :]}$"}
    for before in (-1, 0, 1):
        for behind in (-1, 0, 1):
            n = m - before - behind
            if n > SHORT:
                a = n // 3
                keys |= {f"-{token[c + before : max(0, m - d - behind)]}" for c in (a, a + 1) for d in (a, a + 1)}
    return keys


class Trie:
    """Words as nested maps; the empty key marks an end."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = word

    def search(self, token: str, errors: int = ERRORS, plain: bool = False) -> dict[str, int]:
        """Every word within ``errors`` confusions and marks of the token, or, if ``plain``, that many edits of any letter, with its errors.

        A state is a node and a place in the token; only states that the automaton can reach with errors left are walked.
        """
        found: dict[str, int] = {}
        best: dict[tuple[int, int], int] = {}
        stack = [(self.root, 0, 0)]
        end = len(token)
        while stack:
            node, at, spent = stack.pop()
            key = (id(node), at)
            if best.get(key, errors + 1) <= spent:
                continue
            best[key] = spent
            if at == end:
                if "" in node and spent < found.get(node[""], errors + 1):
                    found[node[""]] = spent
                if plain and spent < errors:
                    stack.extend((child, at, spent + 1) for letter, child in node.items() if letter)
                continue
            letter = token[at]
            if letter in node:
                stack.append((node[letter], at + 1, spent))
            if spent == errors:
                continue
            if letter in MARKS:
                stack.append((node, at + 1, spent + 1))
            for seen in (letter, token[at : at + 2]):
                for meant in CONFUSIONS.get(seen, ()):
                    goal = node
                    for x in meant:
                        goal = goal.get(x)
                        if goal is None:
                            break
                    else:
                        stack.append((goal, at + len(seen), spent + 1))
            if plain:
                stack.append((node, at + 1, spent + 1))
                for x, child in node.items():
                    if x:
                        stack.append((child, at + 1, spent + 1))
                        stack.append((child, at, spent + 1))
        return found


def skeleton(text: str) -> str:
    """A key on which strings agree that differ by common confusions, letter case, marks and spacing only."""
    out = text.lower()
    for mark in "*^~¬'`´\u00ad":
        out = out.replace(mark, "")
    for seen, meant in (
        ("rn", "m"),
        ("cl", "d"),
        ("li", "h"),
        ("ii", "u"),
        ("ri", "n"),
        ("vv", "w"),
        ("in", "m"),
        ("ni", "m"),
        ("0", "o"),
        ("1", "l"),
        ("|", "l"),
        ("!", "l"),
        ("i", "l"),
        ("5", "s"),
        ("§", "s"),
        ("$", "s"),
        ("†", "t"),
        ("¢", "c"),
        ("e", "c"),
        ("@", "a"),
        ("6", "b"),
        ("9", "g"),
        ("n", "h")
    ):
        out = out.replace(seen, meant)
    return "".join(x for x in out if x.isalnum())
