"""Word lists, patterns and messages that results depend on."""

from __future__ import annotations

# --- Fixed values: characters stripped from the edges of a word --------------
STRIP = "।॥.,;:!?\"'()[]{}|/\\-–—…*#@&%+=<>~`"
STRIP_SHORT = "।.,;:!?\"'()[]{}|/\\-"

# --- Fixed values: words that say nothing about a question's subject ---------
STOPWORDS = (
    "the a an is are was were be been of in on at to for and or as by it its this "
    "that these those with from what which who whom how why when where do does did can could "
    "है हैं था थी थे का की के को में पर से और या यह वह क्या कौन कैसे कब कहाँ क्यों "
    "आहे आहेत होता होती होते चा ची चे ला मध्ये आणि किंवा हे ते काय कोण कसे केव्हा कुठे"
).split()

# --- Fixed values: where a sentence ends -------------------------------------
TERMINATOR = "[।?!॥]"
CLOSING = "[’'”\")\\]ऽ।]*"
OPENING = "(?:[ऀ-ॿ]|[A-Z]|\\d|['\"])"

# --- Fixed values: requests that are refused ---------------------------------
UNSAFE = [
    r"\bhow (?:to|do i) (?:make|build|synthesi[sz]e) (?:a )?(?:bomb|explosive|nerve agent|napalm)\b",
    r"\b(?:make|build|construct) (?:a )?(?:pipe bomb|dirty bomb|suicide vest)\b",
    r"\bhow (?:to|do i) (?:kill|murder|poison) (?:someone|somebody|a person|my)\b",
    r"\bchild (?:porn|sexual abuse material)\b|\bcsam\b",
    r"\bhow (?:to|do i) (?:hack|breach) (?:into )?(?:someone|somebody|his|her|their)\b",
    r"बम\s*(?:कैसे|कसे)\s*बना",
    r"(?:किसी को|कोणाला)\s*(?:कैसे|कसे)\s*(?:मार|जान से मार)",
    r"ज़हर\s*(?:कैसे|कसे)\s*(?:दे|बना)",
]
INJECTION = [
    r"\bignore (?:all )?(?:previous|prior|above) (?:instructions|prompts?|rules)\b",
    r"\bdisregard (?:all )?(?:previous|prior|your) (?:instructions|rules)\b",
    r"\b(?:you are|act as|pretend to be) (?:now )?(?:a |an )?(?:different|new)\b",
    r"\b(?:reveal|show|print|repeat|output) (?:me )?(?:your |the )?system prompt\b",
    r"\bwhat (?:are|were) your (?:original )?instructions\b",
    r"\bdeveloper mode\b|\bjailbreak\b|\bDAN mode\b",
    r"पिछले\s*(?:सभी\s*)?निर्देश.*(?:भूल|अनदेखा)",
    r"मागील\s*(?:सर्व\s*)?सूचना.*(?:विसर|दुर्लक्ष)",
]

# --- Fixed values: what a refusal says, by reason ----------------------------
REFUSALS = {
    "empty_query": "Please provide a question.",
    "query_too_short": "That question is too short to search on. Could you give a little more detail?",
    "query_too_long": "That question is too long. Please shorten it.",
    "unsupported_script": "This system answers questions in Hindi, Marathi or English. Please rephrase in one of those languages.",
    "unsafe_content": "I can't help with that request.",
    "prompt_injection": "I can only answer questions about the content in my knowledge base.",
    "no_relevant_context": "I couldn't find relevant information in the knowledge base to answer this question.",
    "low_similarity": "I couldn't find anything in the knowledge base that closely matches this question, so I'd rather not guess.",
    "ambiguous_retrieval": "I couldn't confidently identify relevant information for this question.",
    "model_reported_insufficient": "The retrieved context doesn't contain enough information to answer this question.",
    "low_model_confidence": "I'm not confident enough in an answer from the available context.",
    "ungrounded_answer": "I couldn't produce an answer reliably supported by the knowledge base, so I'd rather not answer.",
    "invalid_citations": "I couldn't verify the sources for that answer.",
    "language_mismatch": "I couldn't answer in the language of your question reliably.",
}
REFUSAL_OTHERWISE = "I can't answer that."

# --- Fixed values: audio containers and their codecs -------------------------
CODECS = {
    ".wav": "wav", ".wave": "wav", ".mp3": "mp3", ".webm": "webm", ".ogg": "ogg", ".oga": "ogg",
    ".opus": "ogg", ".m4a": "mp4", ".mp4": "mp4", ".aac": "mp4", ".flac": "flac",
}
UPLOAD_SUFFIXES = (".wav", ".mp3", ".m4a", ".webm", ".ogg", ".oga", ".aac", ".flac", ".opus")

# --- Fixed values: how errors tell of a limit and a wait ---------------------
RATE_LIMIT = "429|rate limit|quota|resource_exhausted"
RETRY_AFTER = r'(?:retryDelay"?\s*:\s*"?|try again in\s*)(\d+(?:\.\d+)?)\s*s'
