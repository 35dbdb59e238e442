"""Word lists and patterns.  All values in this module are fixed: results depend on each of them."""

# Vocabulary markers, (multiplier, severity).
MARKERS = {
    "delve": (25.2, "critical"), "delves": (25.2, "critical"), "delving": (25.2, "critical"), "showcasing": (9.2, "critical"), "underscores": (9.1, "critical"), "tapestry": (10.0, "critical"),
    "comprehensive": (5.0, "high"), "crucial": (5.0, "high"), "meticulous": (5.0, "high"), "robust": (5.0, "high"), "pivotal": (5.0, "high"),
    "harness": (3.0, "moderate"), "leverage": (3.0, "moderate"), "utilize": (3.0, "moderate"), "notably": (3.0, "moderate"), "furthermore": (3.0, "moderate"), "bustling": (6.0, "moderate"),
    "vibrant": (4.0, "moderate"), "underpins": (4.0, "moderate"), "nuanced": (4.0, "moderate"), "multifaceted": (5.0, "moderate"), "intricate": (3.0, "moderate"), "realm": (3.0, "moderate"),
}

# What the sentence-level vocabulary analysis adds or sets otherwise.
SENTENCE_MARKERS = {**MARKERS, "meticulously": (5.0, "high"), "multifaceted": (5.0, "high"), "increasingly": (3.0, "moderate")}

# Opening and closing formulas; the last closing one matches its alternatives alone, as intended by none.
OPENINGS = [
    r"(In today's (fast-paced|competitive|digital|modern|complex|evolving))", r"(In an era where)", r"(Have you ever wondered)", r"(In the realm of)", r"(When it comes to)",
    r"(\w+ is one of the most (important|significant|crucial|vital|essential))",
]
CLOSINGS = [
    r"(In conclusion,?)", r"(In summary,?)", r"(To sum up,?)", r"(Whether you're .+ or .+,.+offers)", r"(Both sides present valid)", r"(As (I|we) progress|move forward|continue)",
]

#: What a text that a formula matches holds in lower case, any of it.
FORMULA_WORDS = dict(
    zip(
        [*OPENINGS, *CLOSINGS],
        [
            ["in today's "], ["in an era where"], ["have you ever wondered"], ["in the realm of"], ["when it comes to"], [" is one of the most "],
            ["in conclusion"], ["in summary"], ["to sum up"], ["whether you're "], ["both sides present valid"], ["progress", "move forward", "continue"],
        ],
        strict=True,
    )
)

# Transition words.
TRANSITIONS = ["firstly", "secondly", "thirdly", "finally", "moreover", "furthermore", "additionally", "however", "therefore", "consequently"]

# Content word and phrase lists.
HEDGES = ["perhaps", "maybe", "possibly", "might", "could", "seem", "appear", "likely", "probably", "generally", "typically", "often", "usually"]
CLICHES = [
    "at the end of the day", "it goes without saying", "in a nutshell", "food for thought", "think outside the box", "game changer",
    "low-hanging fruit", "deep dive", "paradigm shift", "cutting edge", "best practices", "value proposition",
]
SUPERLATIVES = ["very", "extremely", "incredibly", "highly", "absolutely", "truly", "really", "completely", "utterly", "definitely", "most important", "best", "worst", "greatest"]
MOST = ["important", "significant", "critical", "valuable"]
FILLERS = ["as mentioned earlier", "it is worth noting", "in this context", "given the above", "with that said", "that being said"]

# Phrases that the n-gram analysis counts as plain substrings.
PHRASES = [
    "it's worth noting that", "in light of this", "it is important to", "this approach ensures", "in today's digital age",
    "when it comes to", "in the realm of", "let's dive into", "in conclusion", "to sum up",
]

# Invisible characters.
INVISIBLE = "\u200b\u200c\u200d\u202f\u2060\u00ad\ufeff"

# Small words that the cleanup takes for doubled by mistake.
DOUBLED = (
    "a an and as at be but by do for from had has have he her him his I if in into is it its my no not of on or our own she so than that the their them then there these they this "
    "to up us was we were what when which who will with would you your"
).split()
