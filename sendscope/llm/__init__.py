"""Operations of a training-data pipeline over a ``documents`` table.

One module per operator; ``queries`` registers them. Nothing else in the
library imports this subpackage. Conventions shared by all operators:

* only the columns an operator names are read, so extra or clashing columns
  of the input never reach its plan;
* a null text counts as an empty text unless the docstring says otherwise;
* repeated rows each give a row; a null ``doc_id`` stays null and, where ids
  are compared, comes after all others.
"""
