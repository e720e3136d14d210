import gc
import time

from cartulary.storage import _managed, release


def test_release_shrinks_the_drivers_heap_and_leaves_its_setting(spark):
    java, gateway = spark.sparkContext._jvm.java, spark.sparkContext._gateway
    runtime = java.lang.Runtime.getRuntime()
    live = [gateway.new_array(java.lang.Object, 1 << 18) for _ in range(100)]
    more = [gateway.new_array(java.lang.Object, 1 << 18) for _ in range(500)]
    del more
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        java.lang.System.gc()
    before = runtime.totalMemory()
    release(spark)
    assert len(live) == 100
    assert runtime.totalMemory() < 0.8 * before
    assert _managed(spark, "HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio").get("value") == "70"


def test_release_returns_what_the_jvm_has_freed_outside_its_heap(spark):
    java = spark.sparkContext._jvm.java
    pid = java.lang.ProcessHandle.current().pid()

    def resident() -> float:
        with open(f"/proc/{pid}/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    held = []
    for k in range(3000):
        buffer = java.nio.ByteBuffer.allocateDirect(1 << 16)
        if k % 16 == 0:  # these keep the space between from being given back by itself
            held.append(buffer)
    del buffer
    for _ in range(3):
        gc.collect()
        java.lang.System.gc()
        time.sleep(0.5)
    before = resident()
    release(spark)
    assert resident() < before - 50
