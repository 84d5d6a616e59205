"""Extensions for unbounded inputs; the batch operators do not need them."""
