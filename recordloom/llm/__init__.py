"""Training-data operators: near duplicates, token output, language models, mixing.

Nothing outside this folder imports it; the query registry is ``recordloom.llm.queries``.
"""
