"""Parameters of the queries over the test tables."""

#: Target words of the co-occurrence queries, the window, and the word whose row and relations are asked for.
TARGETS = ("the", "of", "and", "to", "in", "that", "is", "for", "with", "de", "la", "le", "der", "die", "que")
WINDOW = 10
ROW_WORD = "the"
#: Rows of the top-n queries.
TOP = 10
#: Words, phrases, terms and keywords whose scores the lookup queries ask for, of every document.
WANTED_WORDS = ("and", "ation", "data", "nowhere", "ter")
#: Pairs of targets whose relation is asked for.
WANTED_PAIRS = (("the", "of"), ("of", "the"), ("the", "the"), ("the", "que"), ("der", "la"))
#: Texts of the queries on in-memory sources.
TEXT = "Alpha beta, the gamma's 3.14. Delta of U.S.A. lines!\nTwo of\u00a0them"
CORPUS = (TEXT, "", "Epsilon; the zeta", "the of")
#: Lower-case letters beyond ASCII, which the SQL maps to one byte each for its distance in bytes.
LETTERS = "\u00df\u00e0\u00e1\u00e2\u00e3\u00e4\u00e6\u00e7\u00e8\u00e9\u00ea\u00eb\u00ed\u00ee\u00f1\u00f3\u00f4\u00f5\u00f6\u00f9\u00fa\u00fb\u00fc\u0153"
#: Steps of the TextRank query that makes a fixed number of them.
FIXED_STEPS = 4
