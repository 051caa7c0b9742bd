"""What an article is checked against, as default arguments (fixed values); every check takes its own lists instead."""

KEYWORD = "license"
EXPECTED = ["mit license", "software"]
PAIRS = [("the", "and"), ("le", "la"), ("license", "under")]
TRIPLES = [("the", "with", "for"), ("licensed", "under", "license"), ("die", "ist", "und")]
CAUSAL = [("the", "with"), ("le", "pour"), ("licensed", "software")]
MECHANISM = ["for ", "pour ", "because"]
NAMED, NOMINAL, PRONOMINAL = ["license", "the"], ["and ", "la "], ["it ", "elle "]
DEFINITION = [" is ", " est ", " ist "]
PREVIEW = ["in this article", "the following"]
HARD_FACTS = ["MIT", "2.0", "1 000"]
QUESTIONS = ["which license covers the software", "elleai pour leaux"]
OPENERS = ["the ", "de ", "le "]
META_OPENERS = ["in this article", "the of", "as "]
META = [r"needs? verification", r"TODO|FIXME", r"\[(?:citation|source)[^\]]*\]", r"worth noting"]
BANNED = ["worth it", "the and", "pour le"]
FORBIDDEN = ["it is worth", "in summary", "of the"]
SPELLED = ["License", "licensed under", "software"]
WEIGHTS = {"salience": 25, "triples": 15, "causal": 15, "pairs": 10, "variety": 10, "grams": 10, "opening": 10, "facts": 5}
