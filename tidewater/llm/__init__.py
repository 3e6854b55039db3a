"""Training-data operators: one module per operator, queries in ``queries``.

Shared conventions (every operator):

* a row of ``documents`` is one document; repeated rows count as separate rows;
* null text is the empty text; a null ``doc_id`` is carried through as null;
* extra input columns are ignored, whatever their names (also names that differ
  from ``doc_id``/``text`` only by case);
* an empty table gives an empty result with the same schema.
"""
