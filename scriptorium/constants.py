"""Fixed values. They decide results, so they are stated here as plain text."""

# Sizes and thresholds (defaults of the operators; every one is a parameter where it is used).
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
COOCCURRENCE_RADIUS = 500
MIN_OCCURRENCES = 2
MIN_ACRONYM_LENGTH = 2
TOP_K = 5
TOP_K_SMALL = 3
DISTANCE_CUTOFF = 1.5
ROW_TOLERANCE = 10
MIN_REGION_SIDE = 100
ACRONYM_NODE_SIZE = 300
TERM_NODE_SIZE = 100
TERM_NODE_STEP = 10
EDGE_WIDTH_STEP = 0.5
ACRONYM_COLOUR = "red"
TERM_COLOUR = "skyblue"
MAX_TOKENS = 800
TEMPERATURE = 0.5
CHAT_MODEL = "local-model"
EMBEDDING_DIM = 64

# Kinds of dictionary elements.
KIND_ACRONYM = "acronimo"
KIND_TERM = "termino"

# Texts that appear in results.
SOURCE_PREFIX = "Archivo: "
SOURCE_FALLBACK = "Fragmento Markdown "
SOURCE_UNKNOWN = "Desconocido"
NOTHING_FOUND = "No se encontró información relevante"
NOTHING_RELEVANT = "No se encontró información suficientemente relevante para tu pregunta."
PAGE_HEADING = "## Página "
TABLES_HEADING = "\n### Tablas detectadas en esta página:\n"
TABLE_TITLE = "**Tabla "
TABLE_EMPTY = "*No se pudo extraer el contenido de la tabla*"
COLUMN_NAME = "Columna "
CELLS_MISSING = "[Table detected but content extraction failed]"
ROWS_FAILED = "[Table content could not be extracted properly]"
FOLDER_MISSING = "Error: Input folder '{}' does not exist"
FOLDER_EMPTY = "No PDF files found in '{}'"
ANSWER_HTTP_ERROR = "Error al procesar la consulta: "
ANSWER_ERROR = "Lo siento, hubo un error al procesar tu pregunta con el modelo local."
LABEL_ACRONYM = "ACRÓNIMO: "
LABEL_TERM = "TÉRMINO: "
LABEL_DEFINITION = "DEFINICIÓN: "
LABEL_OCCURRENCES = "OCURRENCIAS: "
LABEL_FILES = "APARECE EN: "
LABEL_CONNECTIONS = "RELACIONADO CON: "

# The prompt, in four fixed pieces around domain, context and question.
PROMPT_ROLE = "Eres un asistente experto en "
PROMPT_RULES = """.
Tu tarea es responder preguntas utilizando ÚNICAMENTE la información proporcionada en el contexto.
Si la información no está en el contexto, indica que no tienes esa información.
No inventes ni añadas información que no esté en el contexto proporcionado.

CONTEXTO:
"""
PROMPT_QUESTION = """

PREGUNTA:
"""
PROMPT_INSTRUCTIONS = """

INSTRUCCIONES:
1. Proporciona una respuesta clara y concisa basada ÚNICAMENTE en el contexto dado.
2. Cita las fuentes específicas del contexto que utilizaste para tu respuesta.
3. Si la información en el contexto es insuficiente, indícalo claramente.
"""

# Unicode whitespace as a character class (Java and RE2 syntax alike).
SPACE = (
    r"[\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same characters as a string, for trimming.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Default stop words: frequent Spanish function words. A deployment passes its own list.
STOP_WORDS = (
    "a al algo ante como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era "
    "es esa ese eso esta este esto fue ha hasta hay la las le les lo los me mi muy no nos o os para pero por "
    "porque que qué se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo"
).split()

# Noun rule of the default tagger, and the words it must not call nouns.
MIN_NOUN_LENGTH = 5
NOUN_TAG = "NN"
OTHER_TAG = "XX"
NOT_NOUNS = "about after again could should their there these those under where which while would".split()

# Plural endings of the default lemma rule, tried in this order: (ending, replacement).
PLURAL_RULES = (
    ("ies", "y"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("xes", "x"),
    ("zes", "z"),
    ("sses", "ss"),
)
NOT_PLURAL = ("ss", "us", "is")
