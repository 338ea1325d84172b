"""Record types, as Spark schemas (DDL)."""

INPUT_FILE = "path string, modificationTime timestamp, length long, content binary"
RAW_DOCUMENT = "doc_id string, title string, raw_text string, metadata map<string,string>"
PROCESSED_DOCUMENT = "texto string, metadata struct<total_palabras:int, atributo_adicional:string, fuente:string, tipo_fuente:string, idioma:string, doc_id:string, Fenomeno:string>"
CHUNK = "doc_id string, chunk_id string, fuente string, formato string, fenomeno int, posicion int, num_tokens int, texto string"
ENCODER_HEADER = "type string, encoder_name string, max_words int, overlap_sentences int"
EMBEDDING = "chunk_id string, encoder string, embedding array<float>"
TRIPLE = "sujeto string, tipo_sujeto string, relacion string, objeto string, tipo_objeto string, chunk_id string, doc_id string, fenomeno int"
NODE = "id string, label string, entity_type string"
EDGE = "src string, dst string, relation string, chunk_id array<string>, doc_id string, fenomeno int"
DICTIONARY = "word string, count long"
QUERY = "query_id string, query_text string"
RESPONSE = "query_id string, documents array<struct<rank:int, doc_id:string>>, fragments array<struct<rank:int, chunk_id:string, doc_id:string, text:string>>"
ARTICLE = (
    "doc_id string, id string, title string, titulo string, sections array<struct<heading:string, paragraphs:array<string>>>, lists array<string>,"
    " body_text string, body_paragraphs array<string>, links array<struct<text:string, url:string>>, metadata map<string,string>"
)
GEO_FEATURE = "id string, properties map<string,string>, geometry struct<type:string, coordinates:string>"
PAGED_BLOCK = "doc_id string, page int, y0 double, kind string, lines array<string>, cells array<array<string>>"
