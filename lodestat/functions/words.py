"""Fixed word lists."""

# fixed values: English stop words of the common toolkit list
STOPWORDS_ENGLISH = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his "
    "himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had having do does did doing a an the and but "
    "if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don don't should "
    "should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't "
    "weren weren't won won't wouldn wouldn't"
).split()

# fixed values: frequent function words by language, for the language profile
LANGUAGE_PROFILES = {
    "en": "the of and to in is that it for was on with be as by this are at from have not".split(),
    "fr": "le la les des et est une dans que qui pour pas sur avec au ce il elle du ne".split(),
    "de": "der die und das den von zu mit ist nicht des auf ein eine dem sich als auch es im".split(),
    "es": "el los las y en una por con para del se no su al lo como pero sus le ha".split(),
}

# fixed values: a small sentiment lexicon (word, score)
SENTIMENT = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "happy": 2.7, "love": 3.2, "best": 3.2, "nice": 1.8, "positive": 2.6,
    "wonderful": 2.7, "amazing": 2.8, "perfect": 2.7, "fun": 2.3, "like": 1.5, "win": 2.8, "easy": 1.9, "thanks": 1.9,
    "bad": -2.5, "terrible": -2.1, "awful": -2.0, "sad": -2.1, "hate": -2.7, "worst": -3.1, "poor": -2.1, "negative": -2.7,
    "horrible": -2.5, "wrong": -2.1, "problem": -1.7, "fail": -2.5, "error": -1.7, "hard": -0.4, "slow": -0.8, "angry": -2.3,
}

# fixed values: entity patterns by label
ENTITY_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "URL": r"https?://[^\s<>\"']+",
    "IP": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "DATE": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "NUMBER": r"\b[0-9]+\b",
}
