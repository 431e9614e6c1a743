"""How stored postings are dealt: known to those who write them and those who read them."""

#: Folders that tokens are dealt to.
BUCKETS = 32
