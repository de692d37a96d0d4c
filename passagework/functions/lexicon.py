"""Word lists and patterns that results depend on. All text is NFC-decomposed where nukta letters occur."""

#: Words that carry no topic; dropped from a query.
STOPWORDS = [
    "क्या", "कैसे", "कितने", "कितना", "कितनी", "कौन", "कहाँ", "क्यों", "कब", "है", "हैं", "हो", "होता", "होती", "होते", "था", "थे", "की", "के", "का", "को", "में",
    "से", "पर", "और", "यह", "वह", "ये", "वे", "एक", "इस", "उस", "मेरे", "मेरी", "अपने", "अपनी", "बच्चे", "बच्चा", "बेटी", "बेटा", "रही", "रहा", "दीजिए", "कीजिए",
    "बताइए", "समझा", "सिखाऊँ", "करें", "करते", "क्रम", "मतलब", "फर्क", "अंतर", "तरीका", "वाला", "वाली", "जैसी", "जैसे", "नहीं", "आ", "ना", "तो", "भी", "या", "ही",
]

#: A parent's word and the book's.
PARENT_TO_BOOK = {
    "नक्शा": ["मानचित्र", "दिशा"], "नक्शे": ["मानचित्र", "दिशा"], "सममिति": ["अक्ष", "मोड़", "अभिकल्पना"], "सममित": ["अक्ष", "मोड़"], "दर्पण": ["अक्ष", "मोड़"],
    "रास्ता": ["मार्ग"], "पहाड़ा": ["गुणन", "गुणा"], "बटा": ["भिन्न"], "पौना": ["भिन्न"], "डेढ़": ["भिन्न"], "वजन": ["भार"], "नापना": ["माप", "मापन"],
    "पैसा": ["रुपये"], "रुपया": ["रुपये"], "बाकी": ["शेष", "शेषफल"], "तिकोना": ["त्रिभुज"], "भारी": ["भार"], "हल्का": ["भार"], "खाली": ["रिक्त"], "दुगना": ["दोगुना"],
    "तिगुना": ["गुना", "गुणन"], "चौगुना": ["गुना", "गुणन"],
}

#: English words and the book's.
ENGLISH_TO_BOOK = {
    "fraction": ["भिन्न"], "fractions": ["भिन्न"], "numerator": ["अंश"], "denominator": ["हर"], "half": ["आधा"], "quarter": ["चौथाई"], "third": ["तिहाई"],
    "number": ["संख्या"], "numbers": ["संख्या"], "digit": ["अंक"], "place": ["स्थानीय", "मान"], "value": ["मान"], "tens": ["दहाई"], "hundreds": ["सैकड़ा"],
    "thousand": ["हजार"], "add": ["जोड़", "योग"], "addition": ["जोड़", "योग"], "adding": ["जोड़"], "carry": ["हासिल"], "carrying": ["हासिल"],
    "subtract": ["घटा", "व्यवकलन"], "subtraction": ["घटा", "व्यवकलन"], "multiply": ["गुणा"], "multiplication": ["गुणा", "गुणन"], "divide": ["भाग"],
    "division": ["भाग"], "quotient": ["भागफल"], "divisor": ["भाजक"], "dividend": ["भाज्य"], "remainder": ["शेषफल"], "multiple": ["गुणज"], "multiples": ["गुणज"],
    "factor": ["गुणनखंड"], "even": ["सम"], "odd": ["विषम"], "estimate": ["आकलन"], "angle": ["कोण"], "angles": ["कोण"], "turn": ["घुमाव"], "triangle": ["त्रिभुज"],
    "square": ["वर्ग"], "rectangle": ["आयत"], "pentagon": ["पंचभुज"], "hexagon": ["षट्भुज"], "side": ["भुजा"], "shape": ["आकृति"], "shapes": ["आकृति"],
    "tile": ["टाइल"], "tiling": ["टाइल"], "pattern": ["प्रतिरूप"], "symmetry": ["सममिति"], "area": ["क्षेत्रफल"], "perimeter": ["परिमाप"], "length": ["लंबाई"],
    "height": ["ऊँचाई"], "distance": ["दूरी"], "metre": ["मीटर"], "meter": ["मीटर"], "centimetre": ["सेंटीमीटर"], "centimeter": ["सेंटीमीटर"],
    "kilometre": ["किलोमीटर"], "cm": ["सेंटीमीटर"], "km": ["किलोमीटर"], "measure": ["माप"], "measurement": ["मापन", "माप"], "unit": ["इकाई"], "weight": ["भार"],
    "weigh": ["तोल"], "balance": ["तराजू"], "kilogram": ["किलोग्राम"], "kg": ["किलोग्राम"], "gram": ["ग्राम"], "kilo": ["किलो"], "capacity": ["धारिता", "क्षमता"],
    "litre": ["लीटर"], "liter": ["लीटर"], "millilitre": ["मिलीलीटर"], "time": ["समय"], "hour": ["घंटा"], "minute": ["मिनट"], "second": ["सेकंड"], "clock": ["घड़ी"],
    "map": ["मानचित्र"], "direction": ["दिशा"], "north": ["उत्तर"], "south": ["दक्षिण"], "east": ["पूरब"], "west": ["पश्चिम"], "money": ["रुपये"], "rupee": ["रुपये"],
    "rupees": ["रुपये"], "cost": ["मूल्य"], "price": ["मूल्य"], "graph": ["आरेख"], "chart": ["आरेख"], "table": ["तालिका"], "teach": ["सिखा"], "explain": ["समझा"],
    "child": ["बच्चे"],
}

#: Stems that name a topic of the book.
TOPIC_WORDS = [
    "भिन्न", "अंश", "हर", "आधा", "आधे", "चौथाई", "तिहाई", "पूर्ण", "संख्या", "अंक", "इकाई", "दहाई", "सैकड़ा", "हजार", "गिन", "अल्पविराम", "जोड़", "घटा", "गुणा",
    "गुणन", "भाग", "गुणज", "योग", "व्यवकलन", "शेष", "भाज्य", "भाजक", "भागफल", "सम", "विषम", "हासिल", "कोण", "समकोण", "घुमाव", "त्रिभुज", "वर्ग", "पंचभुज", "षट्भुज",
    "भुजा", "आकृति", "आकार", "टाइल", "प्रतिरूप", "सममिति", "घन", "टैनग्राम", "फिरकी", "क्षेत्रफल", "परिमाप", "लंबाई", "ऊँचाई", "दूरी", "मीटर", "सेंटीमीटर", "किलोमीटर",
    "मापन", "माप", "नाप", "इकाइयाँ", "भार", "तोल", "तराजू", "किलोग्राम", "ग्राम", "किलो", "धारिता", "क्षमता", "लीटर", "मिलीलीटर", "समय", "घंटा", "घंटे", "घंटो",
    "मिनट", "सेकंड", "दिनचर्या", "घड़ी", "मानचित्र", "नक्शा", "नक्शे", "दिशा", "दिशाएँ", "उत्तर", "दक्षिण", "पूरब", "पश्चिम", "अवस्थिति", "आँकड़", "आंकड़", "तालिका",
    "दंड", "आरेख", "चित्रालेख", "गणित", "रुपये", "रुपए", "कीमत", "बचत", "संख्याओं", "अनुमान", "अंदाजा", "आकलन", "बाँट", "बांट", "चौकोर", "डिजाइन", "अभिकल्पना",
    "टुकड़", "घुमा", "ब्लॉक", "छपाई", "रजाई", "कटआउट", "मोड़",
]

#: Endings with a consonant that still belong to a stem.
INFLECTIONS = [
    "ना", "ने", "नी", "कर", "ते", "ता", "ती", "या", "वा",
]

#: Topic words in English.
TOPIC_WORDS_EN = [
    "fraction", "fractions", "numerator", "denominator", "half", "quarter", "third", "whole", "number", "numbers", "digit", "digits", "place value", "ones", "tens",
    "hundreds", "thousand", "count", "counting", "comma", "add", "adding", "addition", "plus", "subtract", "subtraction", "minus", "multiply", "multiplication",
    "times table", "divide", "division", "dividend", "divisor", "quotient", "remainder", "multiple", "multiples", "factor", "factors", "sum", "carry", "carrying",
    "borrow", "borrowing", "even", "odd", "estimate", "estimation", "rounding", "round off", "angle", "angles", "right angle", "turn", "rotation", "triangle",
    "square", "rectangle", "pentagon", "hexagon", "side", "sides", "shape", "shapes", "tile", "tiles", "tiling", "pattern", "patterns", "symmetry", "symmetric",
    "cube", "tangram", "area", "perimeter", "length", "height", "distance", "metre", "meter", "centimetre", "centimeter", "kilometre", "kilometer", "measure",
    "measuring", "measurement", "unit", "units", "weight", "weigh", "weighing", "balance", "kilogram", "gram", "kilo", "capacity", "volume", "litre", "liter",
    "millilitre", "milliliter", "time", "hour", "hours", "minute", "minutes", "second", "seconds", "clock", "calendar", "routine", "map", "direction", "directions",
    "north", "south", "east", "west", "position", "grid", "money", "rupee", "rupees", "paise", "cost", "price", "bill", "change", "graph", "bar graph", "chart",
    "table", "data", "tally", "maths", "math", "mathematics", "sum", "problem", "homework", "cm", "mm", "km", "kg", "gm", "ml", "hr", "min", "sec",
]

#: Stems by group of topics.
TOPIC_GROUPS = {
    "fractions": ["भिन्न", "अंश", "हर", "आधा", "आधे", "चौथाई", "तिहाई"], "numbers": ["संख्या", "अंक", "इकाई", "दहाई", "सैकड़ा", "हजार", "अल्पविराम", "संख्याओं"],
    "operations": ["जोड़", "घटा", "गुणा", "गुणन", "भाग", "गुणज", "योग", "व्यवकलन", "शेष", "भाज्य", "भाजक", "भागफल", "हासिल", "बाँट", "बांट"],
    "geometry": ["कोण", "समकोण", "घुमाव", "त्रिभुज", "वर्ग", "पंचभुज", "षट्भुज", "भुजा", "आकृति", "आकार", "टाइल", "प्रतिरूप", "सममिति", "घन", "टैनग्राम", "चौकोर", "डिजाइन"],
    "length": ["लंबाई", "ऊँचाई", "दूरी", "मीटर", "सेंटीमीटर", "किलोमीटर", "क्षेत्रफल"],
    "weight": ["भार", "तोल", "तराजू", "किलोग्राम", "ग्राम", "किलो", "धारिता", "क्षमता", "लीटर", "मिलीलीटर"],
    "time": ["समय", "घंटा", "घंटे", "घंटो", "मिनट", "सेकंड", "दिनचर्या", "घड़ी"], "maps": ["मानचित्र", "नक्शा", "नक्शे", "दिशा", "दिशाएँ", "अवस्थिति"],
    "data": ["आँकड़", "आंकड़", "तालिका", "दंड", "आरेख", "चित्रालेख"],
}

#: Stems of topics that the book does not have (patterns).
BEYOND_WORDS = [
    "बीजीय", "समीकरण", "व्यंजक", "सर्वसमिका", "बहुपद", "चर\\s*राशि", "घातांक", "वर्गमूल", "घनमूल", "प्रतिशत", "अनुपात", "समानुपात", "ब्याज", "परिमेय", "अपरिमेय",
    "दशमलव", "निर्देशांक", "सर्वांगसम", "प्रमेय", "प्रायिकता", "माध्यिका", "बहुलक", "त्रिकोणमिति", "ऋणात्मक", "पूर्णांक", "द्विघात", "गुणनखंडन", "पाइथागोरस", "साइन",
    "कोज्या",
]

#: The same in English.
BEYOND_WORDS_EN = [
    "algebra", "algebraic", "equation", "equations", "expression", "identity", "polynomial", "variable", "exponent", "exponents", "square root", "cube root",
    "percent", "percentage", "ratio", "proportion", "interest", "rational", "irrational", "decimal", "decimals", "coordinate", "coordinates", "congruent", "theorem",
    "probability", "median", "trigonometry", "sine", "cosine", "negative number", "integer", "integers", "quadratic", "factorise", "factorize", "pythagoras",
    "pythagorean", "calculus", "logarithm",
]

#: Stems that mark a chunk of another book.
OUTSIDE_WORDS = [
    "बीजीय", "समीकरण", "व्यंजक", "सर्वसमिका", "घातांक", "घात", "वर्गमूल", "घनमूल", "प्रतिशत", "अनुपात", "समानुपात", "परिमेय", "अपरिमेय", "दशमलव", "निर्देशांक",
    "सर्वांगसम", "प्रमेय", "प्रायिकता", "माध्यिका",
]

#: Concept tags: pattern, tag; the more specific first.
TAG_VOCABULARY = [
    ("तुल्य\\s*भिन्न|समतुल्य", "fractions.equivalent"), ("भिन्न\\s*किट", "fractions.manipulatives"), ("भिन्न", "fractions"), ("स्थानीय\\s*मान", "numbers.place_value"),
    ("दस\\s*हजार|लाख|हजार", "numbers.large_numbers"), ("संख्या\\s*रेखा", "numbers.number_line"), ("पूर्वानुमान|आकलन", "numbers.estimation"),
    ("गुणनखंड|गुणज", "arithmetic.factors_multiples"), ("गुणा|गुणन", "arithmetic.multiplication"), ("भाग\\s*दे|विभाजन|भाजक|भाज्य|भागफल|शेषफल", "arithmetic.division"),
    ("जोड़|योग", "arithmetic.addition"), ("घटा|व्यवकलन|अंतर\\s*ज्ञात", "arithmetic.subtraction"), ("दशमलव", "arithmetic.decimals"),
    ("सममिति|सममितीय|दर्पण", "geometry.symmetry"), ("घुमाव|कोण|समकोण", "geometry.angles"), ("टाइल|प्रतिरूप|टैनग्राम", "geometry.tiling_patterns"),
    ("त्रिभुज|चतुर्भुज|पंचभुज|षट्भुज|बहुभुज|वर्ग", "geometry.polygons"), ("मानचित्र|अवस्थिति|दिशा", "geometry.maps_position"),
    ("घन|घनाभ|त्रिविमीय", "geometry.3d_shapes"), ("क्षेत्रफल", "measurement.area"), ("परिमाप", "measurement.perimeter"),
    ("धारिता|लीटर|मिलीलीटर", "measurement.capacity"), ("भार|किलोग्राम|ग्राम|तौल", "measurement.weight"), ("सेकंड|मिनट|घंटे|घंटा|समय|दिनचर्या", "measurement.time"),
    ("दूरी|लंबाई|लंबाइयों|मीटर|सेंटीमीटर|किलोमीटर", "measurement.length"), ("इकाई|इकाइयाँ|इकाइयों|मात्रक", "measurement.units"),
    ("रुपये|रुपए|₹|मुद्रा|कीमत|बचत", "money"), ("दंड\\s*-?\\s*आरेख", "data.bar_graph"), ("चित्रालेख|चित्र\\s*आरेख", "data.pictograph"),
    ("आँकड़|आंकड़|तालिका", "data.handling"),
]

#: Tag of a chapter.
CHAPTER_TAGS = {
    1: "numbers.large_numbers", 2: "fractions", 3: "geometry.angles", 4: "numbers.large_numbers", 5: "measurement.length", 6: "arithmetic.multiplication",
    7: "geometry.tiling_patterns", 8: "measurement.weight", 9: "measurement.area", 10: "geometry.symmetry", 11: "geometry.tiling_patterns", 12: "measurement.time",
    13: "measurement.length", 14: "geometry.maps_position", 15: "data.handling",
}

#: Kinds of callout: kind, pattern.
CALLOUTS = [
    ("teaching_hint", "शिक्षण\\s*संकेत"), ("activity", "आइए\\s*(पता|कर|देख|खेल|समझ)"), ("activity", "मनोरंजन"), ("try_this", "प्रयत्न\\s*कीजिए"),
    ("discuss", "चर्चा\\s*कीजिए"), ("my_turn", "मेरी\\s*(दिनचर्या|बारी)"),
]

#: Terms that must be glossed, with their gloss.
JARGON = {
    "भाज्य": "जिसे बाँटना है", "भाजक": "जिससे बाँट रहे हैं", "भागफल": "बाँटने पर जो मिला", "शेषफल": "जो बच गया", "गुणनफल": "गुणा करने पर जो मिला", "व्यवकलन": "घटाना",
    "क्रमागत": "एक के बाद एक आने वाली", "तुल्य": "एक जैसी", "समतुल्य": "एक जैसी", "प्रतिरूप": "एक जैसा दोहराव", "उर्ध्वाधर": "खड़ी", "क्षैतिज": "लेटी हुई",
    "सममिति": "दोनों तरफ एक जैसा", "धारिता": "कितना समा सकता है", "परिमाप": "चारों तरफ की लंबाई", "क्षेत्रफल": "कितनी जगह घेरता है",
}

#: Number words.
CARDINALS = {
    "शून्य": 0, "एक": 1, "दो": 2, "तीन": 3, "चार": 4, "पाँच": 5, "पांच": 5, "छह": 6, "छः": 6, "सात": 7, "आठ": 8, "नौ": 9, "दस": 10, "ग्यारह": 11, "बारह": 12,
    "पंद्रह": 15, "बीस": 20, "पच्चीस": 25, "पचास": 50, "सौ": 100, "हजार": 1000,
}

#: Words for denominators.
DENOMINATORS = {
    "आधा": 2, "आधे": 2, "आधी": 2, "तिहाई": 3, "चौथाई": 4, "पाव": 4, "पाँचवाँ": 5, "पांचवाँ": 5, "छठवाँ": 6, "छठा": 6, "सातवाँ": 7, "आठवाँ": 8, "नौवाँ": 9, "दसवाँ": 10,
    "बारहवाँ": 12, "बीसवाँ": 20,
}

#: Romanised words that mark a question as Hindi.
ROMAN_MARKERS = [
    "ye", "yeh", "ya", "vo", "woh", "kya", "kyu", "kyun", "kyon", "kaise", "kaisa", "kitne", "kitna", "kitni", "kaun", "kahan", "kab", "hai", "hain", "he", "ho",
    "hota", "hoti", "hote", "tha", "thi", "the", "ka", "ki", "ke", "ko", "se", "me", "mein", "par", "aur", "bhi", "nahi", "nahin", "na", "batao", "bataiye", "samjhao",
    "samjha", "samjhaiye", "sikhao", "karo", "kare", "karna", "dijiye", "mera", "meri", "mere", "apna", "bachcha", "bachche", "beta", "beti", "matlab", "tarika",
    "sawal", "jawab", "padhai", "homework",
]

#: Tokens with a dropped consonant.
CONJUNCT_REPAIRS = {
    "ग्ाम": "ग्राम", "ग्ाम।": "ग्राम।", "ग्ा": "ग्रा", "द्ारा": "द्वारा", "ज्ात": "ज्ञात", "क्ेत्रफल": "क्षेत्रफल", "क्ेत्रफलों": "क्षेत्रफलों", "क्ेत्र": "क्षेत्र",
    "क्ेत्रों": "क्षेत्रों", "मिलीग्ाम": "मिलीग्राम", "किलोग्ाम": "किलोग्राम", "किलाेग्ाम": "किलोग्राम", "मेट्ो": "मेट्रो", "मैट्ो": "मैट्रो", "यात्ा": "यात्रा",
    "यात्ी": "यात्री", "रेललयात्ा।": "रेलयात्रा।", "क्ा": "कक्षा", "क्ाओं": "कक्षाओं", "विद्ालय": "विद्यालय", "विद्ालयय": "विद्यालय", "मात्ा": "मात्रा",
    "मात्ाओं": "मात्राओं", "उद्ान": "उद्यान", "समुद्ी": "समुद्री", "मंत्ी": "मंत्री", "द्ादशफलक": "द्वादशफलक", "अपेक्ा": "अपेक्षा", "सामग्ी": "सामग्री",
    "ग्ाहक": "ग्राहक", "ग्ाहकों": "ग्राहकों", "श्ीनगर": "श्रीनगर", "श्ीवास्तव": "श्रीवास्तव", "प्ारंभ": "प्रारंभ", "प्ारंभिक": "प्रारंभिक", "प्ारूप": "प्रारूप",
    "प्ाप्त": "प्राप्त", "प्ात": "प्रात", "प्ोत्साहित": "प्रोत्साहित", "साग्ेस": "साग्रेस", "श्ेष्ठ": "श्रेष्ठ", "सर्वश्ेष्ठ": "सर्वश्रेष्ठ", "श्ेण्ाु": "श्रेणु",
    "स्ट्ाॅ": "स्ट्रॉ", "लद्ाख": "लद्दाख", "लक्षद्ीप": "लक्षद्वीप", "द्ीपसमूह": "द्वीपसमूह", "अफ्ीका": "अफ्रीका", "डिब्ूगढ़": "डिब्रूगढ़", "कललकत्ा": "कलकत्ता",
    "ट्ेन": "ट्रेन", "ट्ेवलर": "ट्रेवलर", "क्ैतिज": "क्षैतिज", "छात्ाएँ": "छात्राएँ", "पूर्ांकों": "पूर्णांकों", "गत्े": "गत्ते", "गट्े": "गट्टे", "विद्ुत": "विद्युत",
    "विद्ुतकर्मी": "विद्युतकर्मी", "पैलिंड्ोम": "पैलिंड्रोम", "क्ाइस्ट": "क्राइस्ट", "ब्ाजील": "ब्राजील", "ब्ेड": "ब्रेड", "विज्ान": "विज्ञान", "ज्ान": "ज्ञान",
    "जिज्ासा": "जिज्ञासा", "विश्ाम": "विश्राम", "पक्ी": "पक्षी", "गुरुग्ाम": "गुरुग्राम", "गुरुद्ारे": "गुरुद्वारे", "द्ारका": "द्वारका", "द्ार": "द्वार", "घ्ा": "घ",
    "क्षा": "कक्षा", "क्ष": "कक्ष",
}

#: Tokens with a doubled consonant.
DOUBLED_REPAIRS = {
    "अंततर": "अंतर", "अथथवा": "अथवा", "आकललन": "आकलन", "आपपको": "आपको", "आययत": "आयत", "उननका": "उनका", "उननके": "उनके", "उपपयोग": "उपयोग", "एकांततर": "एकांतर",
    "कथथन": "कथन", "किततना": "कितना", "किततनी": "कितनी", "किततने": "कितने", "केववल": "केवल", "गगई": "गई", "चचर": "चर", "चचरघातां": "चरघातां", "चययन": "चयन",
    "जजनसंख्या": "जनसंख्या", "जाननते": "जानते", "जिननसे": "जिनसे", "जिससका": "जिसका", "जिससकी": "जिसकी", "ततक": "तक", "ततथा": "तथा", "ततब": "तब", "ततरह": "तरह",
    "नारिययल": "नारियल", "निययम": "नियम", "पपढ़ने": "पढ़ने", "पपर": "पर", "पपरिणामी": "परिणामी", "पपरिणामों": "परिणामों", "पहुँचचने": "पहुँचने",
    "पुस्तकाललय": "पुस्तकालय", "प्रथथम": "प्रथम", "प्रययत्न": "प्रयत्न", "बैठठकर": "बैठकर", "बौधाययन": "बौधायन", "भीततर": "भीतर", "मिलिययन": "मिलियन", "मीटटर": "मीटर",
    "ययदि": "यदि", "ययद्यपि": "यद्यपि", "ययन": "यन", "ययम": "यम", "ययह": "यह", "ययहाँ": "यहाँ", "ययही": "यही", "रूपांततरण": "रूपांतरण", "रोचचक": "रोचक",
    "ललगाना": "लगाना", "ववर्ष": "वर्ष", "ववह": "वह", "विततरण": "वितरण", "विततरित": "वितरित", "विद्याललय": "विद्यालय", "व्यववकलन": "व्यवकलन", "शशब्दों": "शब्दों",
    "षषय": "षय", "संततरे": "संतरे", "सररलीकरण": "सरलीकरण", "सर्वप्रथथम": "सर्वप्रथम", "सर्ववप्रथम": "सर्वप्रथम", "सर्ववसमि": "सर्वसमि", "ससकता": "सकता",
    "ससकती": "सकती", "ससकते": "सकते", "ससभी": "सभी", "ससमान": "समान", "सहाययक": "सहायक", "सहाययता": "सहायता", "सेंटीमीटटर": "सेंटीमीटर", "सोचचते": "सोचते",
}

#: Tokens that a repair has shortened too far.
RESTORED = {
    "अध्यन": "अध्ययन", "अध्यनों": "अध्ययनों",
}
