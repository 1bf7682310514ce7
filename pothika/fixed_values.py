"""Word lists, tables, patterns and thresholds that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- scripts and folds -------------------------------------------------------------------------
DEVANAGARI_BLOCK = "".join(chr(c) for c in range(0x0900, 0x0980))
GUJARATI_BLOCK = "".join(chr(c) for c in range(0x0A80, 0x0B00))
DANDAS = "।॥"
FOLD_FROM, FOLD_TO = "णषशबळीूईऊैौऐऔँ", "नससवलिुइउेोएओं"
FOLD_DROP = "़्"
ZERO_WIDTH = "​‌‍﻿"

# --- words -------------------------------------------------------------------------------------
TITLE_WORDS = (
    "स्तवन सज्झाय स्वाध्याय स्तुति थोय थुई चैत्यवंदन गीत पद लावणी छंद रास स्तोत्र स्तव गहूंली गहुंली भास "
    "चोवीसी बावनी छत्तीसी बत्तीसी पच्चीसी अष्टक सूत्र आरती पूजा विनती प्रभाती सवैया कवित्त हरियाली फेरी भगवान"
).split()
PART_WORDS = "ढाल ढाळ दुहा दूहा दुहो दूहो दोहा दोहरा कलश सोरठा सोरठो चोपाई चौपाई हाल हाळ टाल टाळ टाई डाल डाळ डुहा डूहा".split()
ORDINALS = (
    "पहेली पहली प्रथम बीजी दूसरी त्रीजी तीसरी चोथी चौथी पांचमी पांचवीं छठ्ठी छठी सातमी सातवीं आठमी आठवीं "
    "नवमी नौवीं दशमी दसवीं अगियारमी बारमी तेरमी चौदमी"
).split()
PROSE_WORDS = (
    "है हैं था थी थे थीं होता होती होते होगा होगी किया किये किए कीया गया गयी गई गए जाता जाती जाते "
    "जाना करना करने करते करके करवाया करवाने रहा रही रहे इसका इसके इसकी उसका उसके उसकी जिसके "
    "जिसका जिसकी जिससे जिन्होंने उन्होंने उनके उनकी उनका आपने आपकी आपका आपके हमारे हमने हमें "
    "द्वारा तथा एवं परन्तु परंतु किन्तु लेकिन क्योंकि अतः अर्थात् इसलिये इसलिए यह वह इस उस इन उन "
    "छे छीए हतो हती हता हतुं हतां थयो थयेल थयेला थयेली थयुं थई थाय करवामां करवानी करवाथी आवेल "
    "आवेली आवेला एटले तेमज तेथी माटे अमे अमारी अमारा अमने तेओ तेओश्री तेमना तेमनी तेने तेनी तेना "
    "एवा एवी आवा आवी करीने आपेल छपाववा प्रसिद्ध पुस्तक पुस्तकमां ग्रंथ ग्रन्थ इत्यर्थः"
).split()
EXPLANATION_WORDS = (
    "व्याख्या भावार्थ विवेचन विवरण तात्पर्य अनुवाद शब्दार्थ विशेषार्थ सारांश बालावबोध टबार्थ अन्वयार्थ अर्थ टीका "
    "अन्वय समजूती अर्य अथे अये अर्थृ अर्थः व्यास्या व्वास्या व्यार्या न्यार्या व्यारूपा"
).split()
INDEX_WORDS = "अनुक्रम अनुक्रमणिका विषयानुक्रम विषयानुक्रमणिका विषयसूची सूची सूचि नामावली शुद्धिपत्रक शुद्धिपत्र".split()
FIRST_LINE_PHRASES = ["प्रथमपद", "प्रथम पद", "आदिपद", "आद्यपद", "प्रथम पंक्ति"]
TUNE_WORDS = "देशी देसी एहनी एहनो चाल छन्दः छन्द छंद रागः राग रागेण तर्ज".split()

# --- patterns that Java, Python and RE2 read alike ---------------------------------------------
FURNITURE_KEY = r"[\d\[\]()%|।॥.:*\-–—]+"
FOOTNOTE = r"^\s*([#*†]|\(?\s*(पाठान्तर|पाटान्तर|पाठांतर|टिप्पणी|टीप)([^\p{L}\p{M}]|$))"
NUMBER_LINE = r"^[\d\s\-–—()\[\].|]+$"
INDEX_LEADER = r"^[^\n]{0,40}?[.\-_…·]{4,}\s*\d{1,4}\s*(\n|$)"
VERSE_NO = r"[।॥]\s*\d{1,3}\s*[।॥]"
MARK_DANDA = r"[।॥]\s*([\dIl|\[\]()!]{1,3}|\s?)\s*[।॥]"
MARK_DOTS = r"\.{2,}\s*([^\s.]{0,2})\s*\.*[ \t]*(?=\n|$)"
MARK_NUM_STOP = r"(?<=[\s,;])(\d{1,3})\.(?=\s)"
MARK_LINE_NUM = r"(?<=\S[ \t])(\d{1,3})[ \t]*(?=\n|$)"
SENTENCE_END = r"[।॥!?]+|\.{2,}|\.[ \t]*(\n|$)"
LETTER = r"[\x{0900}-\x{0963}\x{0970}-\x{097F}\x{0A80}-\x{0AE5}\x{0AF0}-\x{0AFF}A-Za-z]"
DEVA_WORD = r"[\x{0900}-\x{097F}]+"
EXPLAINER_CUE = r"(^|[^\x{0900}-\x{097F}])के\s?[0०°\"']"
SOURCE_NOTE = r"^\s*\(.{0,60}(कोश|कोष|कोस|क्रमा[ंङ]?क|क\S?माक|साहित्य)"
#: Ends of verse lines: punctuation or number, a particle, a refrain cue, dots. Spelt without look-behind, which RE2 lacks.
VERSE_END = r"[,;।॥!?)\d]\z|(रे|जी|हो)\z|[^\sक][0०°]\z|[^\sे]क[0०°]\z|(^|[^क])े[0०°]\z|(\.{2,}|…)\s*\S{0,3}\z|\.\s*\S{1,4}\s?\S{0,4}\.\z"
#: Words over the columns of a contents list, and over its page column.
COLUMN_WORDS, PAGE_COLUMN_WORDS = "नाम नाप विषय अंक आंक पृष्ठ".split(), "पृष्ठ पृष्ट पत्र पेज".split()
#: Words that announce a quotation in an explanation.
CITING_WORDS = "यतः यत तथा उक्तं उक्तञ्च यदुक्तं इत्यादि इति".split()
#: Signs trimmed off titles, and off verses.
TITLE_TRIM = " .:-।॥\"'“”"
VERSE_TRIM = TITLE_TRIM + "0123456789,;()[]"
#: Notes and checks of the results.
WEAK_NOTE = "Weak match at {} - verify text"
START_ONLY_NOTE, END_ONLY_NOTE = "Start found, end not found", "End found, start not found"
CHECK_HEADING = "No heading found - check where it starts"
CHECK_LENGTH = "Aadi/Ant is not one clear verse"
CHECK_PAGES = "Spans {} pages - may hold several Kruti"
CHECK_SCAN = "Low OCR quality - check the scan"
CHECK_ORPHAN = "No verse numbers or heading - found by matching the Excel text"
#: Invisible, not white space: no pattern matches across a blanked span.
SEPARATOR = "⁣"


@dataclass(frozen=True)
class Settings:
    """Thresholds and words of a run; every field can be overridden."""

    min_text_chars: int = 30
    min_indic_ratio: float = 0.6
    max_broken_ratio: float = 0.02
    force_ocr: bool = False
    low_ocr_confidence: float = 70
    header_share: float = 0.2
    header_similarity: float = 75
    found_threshold: float = 85
    min_candidate_score: float = 65
    query_max_chars: int = 160
    query_min_chars: int = 15
    max_work_pages: int = 40
    min_verses: int = 2
    max_opening_chars: int = 600
    name_match_threshold: float = 85
    max_work_pages_check: int = 8
    duplicate_threshold: float = 88
    gram: int = 4
    bucket: int = 24
    top_k: int = 12
    min_shared_grams: int = 3
    title_words: list[str] = field(default_factory=lambda: list(TITLE_WORDS))
    part_words: list[str] = field(default_factory=lambda: list(PART_WORDS))
    ordinals: list[str] = field(default_factory=lambda: list(ORDINALS))
