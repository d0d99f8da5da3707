"""Search operators over anything that has postings."""
