"""Prompt templates (our own wording; only the placeholders are shared).

``{question}``/``{context}`` for answering, ``{query}``/``{answer}``/``{result}``
for grading, ``{text}``/``{question_type}`` for Q&A generation and
``{chat_history}``/``{question}`` for condensing a follow-up question.
"""

SYSTEM_TEMPLATE = (
    "You answer questions about the supplied passages only. Do not use outside knowledge. "
    "When the passages do not contain the answer, reply exactly with the refusal sentence. "
    "Finish every answer with a 'SOURCES:' section naming the passages you used."
)
HUMAN_TEMPLATE = (
    "Question: {question}\n\nPassages:\n{context}\n\n"
    "Answer carefully and end with a 'SOURCES:' section listing the supporting URLs."
)
# used when no template file is given
DEFAULT_SYSTEM_TEMPLATE = "You are a helpful assistant for the indexed corpus."
DEFAULT_HUMAN_TEMPLATE = "{question}\n---\nAnswer:"

GRADING_TEMPLATE = (
    "Compare a chatbot answer with a reference answer.\n"
    "Label it INCORRECT when it contradicts or misses essential facts of the reference; "
    "otherwise label it CORRECT.\n\n"
    "QUESTION: {query}\nREFERENCE ANSWER: {answer}\nCHATBOT ANSWER: {result}\n\nGRADE:"
)
GENERATION_TEMPLATE = (
    "TEXT:\n{text}\n\nWrite one {question_type} question answerable from the text alone, "
    "its answer, a confidence from 1 to 100 and a JSON array of references. "
    "Reply with a JSON object with keys question, answer, confidence, references."
)
CONDENSE_TEMPLATE = (
    "Given the conversation so far and a follow-up question, restate the follow-up as a "
    "standalone question.\n\nConversation:\n{chat_history}\nFollow-up: {question}\nStandalone question:"
)
