"""Named queries: each is an operator applied to the message-log views, with the same result in SQL."""
