"""DataFrame -> DataFrame operators; none of them collects or loops over rows."""
