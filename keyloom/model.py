"""Relations of the keyspace engine.

A log of commands is the input; the reply of every command and the state of every key are the outputs.
Times are microseconds; an entry without deadline has a null expires_at_us and is expired from the
moment expires_at_us on.
"""

REPLY = "struct<kind:string,int:bigint,str:string,arr:array<string>>"
LOG = "seq bigint, ts_us bigint, conn_id string, cmd string, args array<string>"
KEYS = "key string, type string, expires_at_us bigint, created_at_us bigint, updated_at_us bigint"
STRINGS = "key string, value string"
HASH_FIELDS = "key string, field string, value string"
LIST_ITEMS = "key string, pos bigint, value string"
SET_MEMBERS = "key string, member string"
ZSET_MEMBERS = "key string, member string, score double"

#: Settings that the semantics rely on; streaming needs the state store.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
